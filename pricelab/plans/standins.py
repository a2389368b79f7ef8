"""Deterministic doubles for the injected models, used by the registered queries and the tests.

Each is a small pure function that SQL can reproduce, so whole pipelines are
checkable. No pipeline uses one unless it is passed.
"""

from __future__ import annotations

import hashlib
import re

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..operators.models import TextModel


def _md5(s: str) -> str:
    return hashlib.md5(s.encode("utf-8")).hexdigest()


_RE_LAST = re.compile(r"LAST_PRICE: (\d+\.\d+)")
_RE_NEXT = re.compile(r"Predict the next (\d+) closing prices")
_RE_PRIOR = re.compile(r"PRIOR_SUMMARY: Chunk (\d+),")
_RE_CHUNK = re.compile(r"NEW_DATA_CHUNK: \[([^\]]*)\]")

PROSE_HEAD = "Sure. Here is my forecast: "
PROSE_TAIL = " -- hope this helps."
NO_NUMBER = "I cannot forecast this stock."


def drift_prices(last: float, n: int) -> list[str]:
    return ["%.2f" % (last * (1.0 + 0.01 * (((k * 7) % 5) - 2))) for k in range(1, n + 1)]


def drift_forecaster() -> TextModel:
    """Reads ``LAST_PRICE`` and the horizon from the prompt; five answer shapes by md5.

    mode 0: exactly n prices; 1: n + 3; 2: max(n // 2, 1); 3: prose around n
    prices; 4: no number at all.
    """

    def model(prompts: list[str]) -> list[str]:
        out = []
        for p in prompts:
            m_last, m_n = _RE_LAST.search(p), _RE_NEXT.search(p)
            if not m_last or not m_n:
                out.append(NO_NUMBER)
                continue
            last, n = float(m_last.group(1)), int(m_n.group(1))
            mode = int(_md5(p)[0], 16) % 5
            if mode == 4:
                out.append(NO_NUMBER)
                continue
            k = {0: n, 1: n + 3, 2: max(n // 2, 1), 3: n}[mode]
            body = " [" + ", ".join(drift_prices(last, k)) + "]"
            out.append(PROSE_HEAD + body + PROSE_TAIL if mode == 3 else body)
        return out

    return model


def last_value_forecaster() -> TextModel:
    """Repeats LAST_PRICE n times."""

    def model(prompts: list[str]) -> list[str]:
        out = []
        for p in prompts:
            m_last, m_n = _RE_LAST.search(p), _RE_NEXT.search(p)
            if not m_last or not m_n:
                out.append(NO_NUMBER)
            else:
                out.append(" [" + ", ".join([m_last.group(1)] * int(m_n.group(1))) + "]")
        return out

    return model


def chunk_summarizer() -> TextModel:
    """``Chunk k, <n> closes from <first> to <last>.``; empty for chunks under 31 closes.

    ``k`` continues the prior summary's count, so the fold result depends on order.
    """

    def model(prompts: list[str]) -> list[str]:
        out = []
        for p in prompts:
            m_c = _RE_CHUNK.search(p)
            vals = [v for v in (m_c.group(1).split(", ") if m_c else []) if v]
            if len(vals) < 31:
                out.append("")
                continue
            m_p = _RE_PRIOR.search(p)
            k = int(m_p.group(1)) + 1 if m_p else 1
            out.append(f"Chunk {k}, {len(vals)} closes from {vals[0]} to {vals[-1]}.")
        return out

    return model


def draft_summarizer() -> TextModel:
    """Answers in the draft's shape for chunks whose last price in cents is a multiple of 8, without the markers for the others."""

    def model(prompts: list[str]) -> list[str]:
        out = []
        for p in prompts:
            m = _RE_CHUNK.search(p)
            vals = [v for v in (m.group(1).split(", ") if m else []) if v]
            if not vals or int(vals[-1].replace(".", "")) % 8:
                out.append("The series goes on. PREDICTION: none")
            else:
                out.append(f"Of course.\nUpdated_Summary:\n  From {vals[0]}\nto {vals[-1]}. \nPREDICTION: [1.00]")
        return out

    return model


def md5_writer() -> TextModel:
    """``REPORT <first 12 hex of md5(prompt)>`` -- pins the prompt byte for byte."""

    def model(prompts: list[str]) -> list[str]:
        return ["REPORT " + _md5(p)[:12] for p in prompts]

    return model


def md5_classifier():
    """headline -> (positive|negative|neutral, 0.50..0.99) from md5 of the title."""
    labels = ["positive", "negative", "neutral"]

    def model(titles: list[str]) -> list[tuple[str, float]]:
        res = []
        for t in titles:
            h = int(_md5(t)[:2], 16)
            res.append((labels[h % 3], 0.5 + (h % 50) / 100.0))
        return res

    return model


def md5_scorer() -> TextModel:
    """Zero-shot label answer; every fourth shape has no decimal point (parses to 0.0)."""

    def model(prompts: list[str]) -> list[str]:
        out = []
        for p in prompts:
            h = int(_md5(p)[:4], 16)
            score = ((h % 201) - 100) / 100.0
            change = ((h // 201) % 1001 - 500) / 100.0
            if h % 4 == 0:
                out.append(f"SENTIMENT_SCORE: {int(score)}, NEXT_DAY_PRICE_CHANGE: {int(change)}%")
            else:
                out.append(f"SENTIMENT_SCORE: {score:.2f}, NEXT_DAY_PRICE_CHANGE: {change:.2f}%")
        return out

    return model


#: (forecaster, summarizer, writer, classifier), as the analyse and backtest pipelines take them.
MODELS = (drift_forecaster, chunk_summarizer, md5_writer, md5_classifier)


def raising(factory, below: str = "4"):
    """The same model, but it raises on a prompt whose md5 has a second digit below ``below`` (and on any batch with one)."""

    def made():
        model = factory()

        def answer(prompts: list[str]):
            for p in prompts:
                if _md5(p)[1] < below:
                    raise RuntimeError("no answer to " + _md5(p)[:8])
            return model(prompts)

        return answer

    return made


def md5_label_cols(title: Column) -> tuple[Column, Column]:
    """SQL form of ``md5_classifier`` (for checks)."""
    h = F.conv(F.substr(F.md5(title), F.lit(1), F.lit(2)), 16, 10).cast("int")
    label = F.element_at(F.array(F.lit("positive"), F.lit("negative"), F.lit("neutral")), h % 3 + 1)
    return label, F.lit(0.5) + (h % 50) / 100.0
