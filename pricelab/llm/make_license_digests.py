"""Writes license_digests.py: digests of the canonical forms of full licence texts.

    python -m pricelab.llm.make_license_digests COMMON CRATES NODE JARS

with the folders of the texts: Debian's common licences, a Cargo registry's sources, an npm installation, Spark's jars.
Each text is taken as a whole, without its title, and without what follows its terms, with http and https addresses,
with and without list numbers for short ones; the canonical form is the same at any width. A text that is not found is named and left out.
"""

from __future__ import annotations

import glob
import os
import re
import sys
import zipfile

from ..session import local_session
from . import licenses

COMMON, CRATES, NODE, JARS = "COMMON/", "CRATES/", "NODE/", "JARS/"  # places of the folders given
GNU = r"(?s)\A.*?Version [\d.]+, \w+ (?:\d+ )?\w*\d{4}\n|(?s:\A.*?\d{4}\n)"
END = r"(?s)(END OF TERMS AND CONDITIONS).*\Z"
#: licence, file, first and last words of the text, titles before it, what its own title matches, what follows its terms.
TEXTS = [
    ("MIT", CRATES + "crc32fast-1.5.0/LICENSE-MIT", "Permission is", None, ("MIT License", "The MIT License", "The MIT License (MIT)", "MIT"), None, None),
    ("BSD-3-Clause", CRATES + "ed25519-dalek-2.1.1/LICENSE", "Redistribution and", None, ("BSD 3-Clause License", "The 3-Clause BSD License", "BSD License", "New BSD License", "The BSD License"), None, None),
    ("BSD-3-Clause", COMMON + "BSD", "Redistribution and", None, ("BSD License",), None, None),
    ("ISC", NODE + "node_modules/glob/LICENSE", "Permission to", "THIS SOFTWARE.", ("ISC License", "The ISC License"), None, None),
    ("0BSD", CRATES + "adler2-2.0.1/LICENSE-0BSD", "Permission to", None, ("BSD Zero Clause License", "Zero-Clause BSD", "BSD 0-Clause License"), None, None),
    ("Zlib", CRATES + "miniz_oxide-0.8.9/LICENSE-ZLIB.md", "This software", None, ("zlib License", "The zlib License", "The zlib/libpng License"), None, None),
    ("Unlicense", CRATES + "globset-0.4.18/UNLICENSE", "This is free", None, ("The Unlicense", "Unlicense"), None, None),
    ("BSL-1.0", CRATES + "xxhash-rust-0.8.15/LICENSE", "Permission is", None, ("Boost Software License - Version 1.0 - August 17th, 2003", "Boost Software License 1.0"), None, None),
    ("Apache-2.0", COMMON + "Apache-2.0", "Apache License", None, (), r"(?s)\A.*?licenses/\n", END),
    *((name, COMMON + f, "GNU", None, (), GNU, END) for name, f in (
        ("GPL-1.0", "GPL-1"), ("GPL-2.0", "GPL-2"), ("GPL-3.0", "GPL-3"), ("LGPL-2.0", "LGPL-2"), ("LGPL-2.1", "LGPL-2.1"), ("LGPL-3.0", "LGPL-3"))),
    *((name, COMMON + f, "GNU", None, (), GNU, r"(?s)()\n *ADDENDUM: How to use.*\Z") for name, f in (("GFDL-1.2", "GFDL-1.2"), ("GFDL-1.3", "GFDL-1.3"))),
    ("MPL-1.1", COMMON + "MPL-1.1", "MOZILLA", None, (), r"(?s)\A.*?Version 1.1\n", r"(?s)()\n *EXHIBIT A.*\Z"),
    ("MPL-2.0", COMMON + "MPL-2.0", "Mozilla", None, (), r"\A.*\n", r"(?s)()\n *Exhibit A.*\Z"),
    ("CC0-1.0", COMMON + "CC0-1.0", "Statement of", None, ("Creative Commons Legal Code\n\nCC0 1.0 Universal", "CC0 1.0 Universal", "Creative Commons CC0 1.0 Universal"), None, None),
    ("CC0-1.0", COMMON + "CC0-1.0", "Creative Commons Legal Code", None, (), r"\A.*\n", None),
    ("Artistic-2.0", NODE + "LICENSE", "Copyright (c) 2000-2006", "SUCH DAMAGE.", ("The Artistic License 2.0", "Artistic License 2.0"), None, None),
    ("EPL-2.0", JARS + "jakarta.annotation-api-2.1.1.jar!META-INF/LICENSE.md", "THE ACCOMPANYING", None, ("Eclipse Public License - v 2.0", "Eclipse Public License Version 2.0"), None, r"(?s)()\n[ #]*Exhibit A\W+Form.*\Z"),
    ("CDDL-1.0", JARS + "jta-1.1.jar!META-INF/LICENSE.txt", "COMMON", "any admission of liability.", (), r"\A.*\n", None),
]
NOTICES = [
    *((x, f"Licensed under the {n}.") for x, n in (
        ("0BSD", "BSD Zero Clause License"), ("BSL-1.0", "Boost Software License, Version 1.0"), ("EPL-2.0", "Eclipse Public License, version 2.0"), ("ISC", "ISC License"), ("Zlib", "zlib License"))),
    ("Unlicense", "Released under the Unlicense."),
    ("AGPL-3.0", "This work is licensed under the GNU Affero General Public License, version 3."),
    ("LGPL-2.1", "This work is licensed under the GNU Lesser General Public License, version 2.1."),
]
STATEMENT = re.compile(r"(?mi)^[ \t]*(copyright[ \t]*(\(c\)|©|\d{4}|[<\[])|©|\(c\)|all rights reserved).*$")


#: Where the Free Software Foundation was: its address is part of the older texts.
ADDRESS = r"(?:51 Franklin St(?:reet)?),?\s+Fifth\s+Floor,?\s+Boston,?\s+MA\s+02110-1301,?\s+USA"
OLDER = ("59 Temple Place, Suite 330, Boston, MA 02111-1307 USA", "675 Mass Ave, Cambridge, MA 02139, USA")


def addresses(text: str) -> list[str]:
    found = [text, *(re.sub(ADDRESS, x, text) for x in OLDER)]
    online = re.sub(rf"write\s+to\s+the\s+Free\s+Software\s+Foundation,\s+Inc\.,\s+{ADDRESS}", "see <https://www.gnu.org/licenses/>", text)
    return [*found, re.sub(ADDRESS, "<https://fsf.org/>", online), re.sub(ADDRESS, "<https://fsf.org/>", online).replace("Ty Coon", "Moe Ghoul")]


def read(path: str, folders: dict[str, str]) -> str | None:
    path, _, member = path.partition("!")
    place, _, rest = path.partition("/")
    path = os.path.join(folders[place], rest)
    if not (found := sorted(glob.glob(path))):
        return None
    if member:
        return zipfile.ZipFile(found[-1]).read(member).decode("utf-8", "replace").replace("\r\n", "\n")
    return open(found[-1], encoding="utf-8").read().replace("\r\n", "\n")


def cut(text: str, first: str, last: str | None) -> str | None:
    text = text[text.find(first) :] if first in text else ""
    if last and last in text:
        return text[: text.find(last) + len(last)]
    return text or None


def texts(folders: dict[str, str]) -> list[tuple[str, str]]:
    out = list(NOTICES)
    for name, path, first, last, titles, own, rest in TEXTS:
        raw = read(path, folders)
        t = raw and cut(raw, first, last)
        if name == "EPL-2.0" and t:  # the exhibit ends the licence, another one follows in the file
            t = re.split(r"(?m)^-{3,}|^#+ *(?:The )?GNU General|^ *The GNU General Public License \(GPL\)", t)[0]
        if not t:
            print("not found:", name, path)
            continue
        bodies = {t, *([re.sub(own, "", t, count=1)] if own else ())}
        bodies |= {re.sub(rest, r"\1", b) for b in bodies} if rest else set()
        named = [(name, x) for b in bodies for x in sorted({*addresses(b)})]
        if name == "MIT":
            a, b = t.index(", subject to"), t.index('THE SOFTWARE IS')
            named.append(("MIT-0", t[:a] + ".\n\n" + t[b:]))
            named.append(("MIT", t.replace("THE\nAUTHORS OR COPYRIGHT HOLDERS", "THE\nAUTHORS")))
        if name == "BSD-3-Clause":
            m = re.search(r"(?s)\n *(?:3\.|\*|-)? *Neither.*?permission\.\n", t)
            if m:
                named.append(("BSD-2-Clause", t[: m.start()] + "\n" + t[m.end() :]))
        if name == "ISC":
            who = re.search(r"AND (.*?) DISCLAIMS?", " ".join(t.split()))[1]
            flat = "\n\n".join(" ".join(p.split()) for p in re.split(r"\n\s*\n", t))
            for holder, verb in (("THE AUTHOR", "DISCLAIMS"), ("THE AUTHORS", "DISCLAIM"), ("THE AUTHOR(S)", "DISCLAIM"), ("THE COPYRIGHT HOLDER", "DISCLAIMS"), ("ISC", "DISCLAIMS")):
                x = re.sub(rf"{re.escape(who)} DISCLAIMS?", f"{holder} {verb}", flat).replace(f"SHALL {who} BE", f"SHALL {holder} BE")
                named += [(name, x), (name, x.replace("and/or", "and")), (name, re.sub(r"\band distribute", "and/or distribute", x))]
        if len(t) < 5000:
            named += [(n, re.sub(r"(?m)^ *(?:\d\.|\(?[a-c1-3]\)|[*-]) +", "", b)) for n, b in named]
        out += [(n, b) for n, b in named]
        own_titles = {"MIT-0": ("MIT No Attribution", "MIT-0"), "BSD-2-Clause": ("BSD 2-Clause License", "The 2-Clause BSD License", "Simplified BSD License", "BSD License")}
        out += [(n, f"{title}\n\n{b}") for n, b in named for title in own_titles.get(n, titles)]
    return out


def layouts(text: str) -> set[str]:
    found = set()
    for x in (text, text.replace("http://", "https://"), text.replace("https://", "http://")):
        found.add(x)
        paragraphs = [" ".join(p.split()) for p in re.split(r"\n\s*\n", STATEMENT.sub("", x))]
        found.add("\n\n".join(paragraphs))
    return found


def rough(text: str) -> str:
    return " ".join(re.sub(r"[\W_]+", " ", re.sub(licenses.COPYRIGHT_LINE, " ", text.lower())).split())


def main(folders: list[str]) -> None:
    forms = {}
    for name, text in texts(dict(zip(("COMMON", "CRATES", "NODE", "JARS"), folders, strict=True))):
        for x in layouts(text):
            forms.setdefault((name, rough(x)), x)
    spark = local_session(app="license-digests")
    rows = [(name, x) for (name, _), x in forms.items()]
    df = licenses.with_form(spark.createDataFrame(rows, "license string, t string"), licenses.F.col("t"), "form")
    by: dict[str, set[str]] = {}
    for r in df.select("license", licenses.digest(licenses.one_line(licenses.F.col("form"))).alias("d")).distinct().toLocalIterator():
        by.setdefault(r["license"], set()).add(r["d"])
    with open(os.path.join(os.path.dirname(os.path.abspath(__file__)), "license_digests.py"), "w") as f:
        f.write('"""Digests of the canonical forms of full licence texts. Written by make_license_digests.py."""\n\nDIGESTS = {\n')
        for name in sorted(by):
            f.write(f'    "{name}": """\n' + "\n".join(sorted(by[name])) + '\n""".split(),\n')
        f.write("}\n")
    print({k: len(v) for k, v in sorted(by.items())})


if __name__ == "__main__":
    main(sys.argv[1:])
