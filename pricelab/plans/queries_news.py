"""Queries: headlines -- selection, union/dedupe, joins to prices, quotas, labels."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import constants as K
from ..functions.scalar import clean_title, date_text, next_change_pct, norm_date
from ..functions.text import fmt2, parse_label_pair, render, summary_trim
from ..operators import features as FE
from ..operators import models as M
from ..operators import news as NW
from . import pipelines as PL
from . import standins as SI
from .catalog import Ctx, r6, register
from .oracle import cte, fmt2_sql, render_sql

ASOF_SQL = "(SELECT max(date) FROM bars)"


def _asof(c: Ctx):
    return c.bars().select(F.max("date")).scalar()


@register("flt_blank_title", """
SELECT ticker, date, source, relevancy FROM headlines WHERE title IS NOT NULL AND title <> ''""", ("headlines",))
def q_flt_blank_title(spark, sf):
    return NW.non_blank(Ctx(spark, sf).headlines()).select("ticker", "date", "source", "relevancy")


@register("sc_clean_title", """
SELECT ticker, relevancy, source, nullif(trim(title), '') AS title_clean FROM headlines""", ("headlines",))
def q_sc_clean_title(spark, sf):
    h = Ctx(spark, sf).headlines()
    return h.select("ticker", "relevancy", "source", clean_title("title").alias("title_clean"))


@register("flt_lookback", f"""
SELECT ticker, date, source, relevancy FROM headlines
WHERE date >= {ASOF_SQL} - 29 AND date <= {ASOF_SQL}""", ("headlines", "bars"))
def q_flt_lookback(spark, sf):
    c = Ctx(spark, sf)
    return NW.lookback(c.headlines(), _asof(c), 29).select("ticker", "date", "source", "relevancy")


@register("src_news", f"""
SELECT ticker, date, title, source, relevancy FROM (
  SELECT *, row_number() OVER (PARTITION BY ticker ORDER BY relevancy, title) AS rn FROM headlines
  WHERE lang = 'en' AND date >= {ASOF_SQL} - 5 AND date <= {ASOF_SQL} AND title IS NOT NULL AND title <> '')
WHERE rn <= 20""", ("headlines", "bars"))
def q_src_news(spark, sf):
    c = Ctx(spark, sf)
    s = NW.select_news(c.headlines(), asof=_asof(c), days=K.NEWS_LOOKBACK_DAYS, lang="en", cap=K.NEWS_CAP)
    return s.select("ticker", "date", "title", "source", "relevancy")


@register("tk_news_cap", f"""
SELECT ticker, date, source, relevancy FROM (
  SELECT *, row_number() OVER (PARTITION BY ticker ORDER BY relevancy, title) AS rn FROM headlines
  WHERE lang = 'en' AND date >= {ASOF_SQL} - 30 AND title IS NOT NULL AND title <> '')
WHERE rn <= 100""", ("headlines", "bars"))
def q_tk_news_cap(spark, sf):
    c = Ctx(spark, sf)
    s = NW.select_news(c.headlines(), asof=_asof(c), days=K.CORPUS_NEWS_LOOKBACK_DAYS, lang="en",
                       cap=K.CORPUS_NEWS_CAP, bounded=False)
    return s.select("ticker", "date", "source", "relevancy")


@register("st_union_headlines", """
SELECT ticker, title, date, source, relevancy FROM (
  SELECT *, row_number() OVER (PARTITION BY ticker, title ORDER BY published_at, date, source, lang, relevancy) AS rn
  FROM headlines WHERE title IS NOT NULL)
WHERE rn = 1""", ("headlines",))
def q_st_union_headlines(spark, sf):
    h = Ctx(spark, sf).headlines().where(F.col("title").isNotNull())
    a = h.where(F.col("source") == "documents")
    b = h.where(F.col("source") == "pages")
    u = NW.union_headlines(a, b)
    return u.select("ticker", "title", "date", "source", "relevancy")


@register("prj_date_norm", """
SELECT ticker, relevancy, source, strftime(published_at, '%Y-%m-%dT%H:%M:%S') AS published_text,
       CAST(split_part(strftime(published_at, '%Y-%m-%dT%H:%M:%S'), 'T', 1) AS DATE) AS date,
       strftime(date, '%Y-%m-%d') AS date_text
FROM headlines""", ("headlines",))
def q_prj_date_norm(spark, sf):
    h = Ctx(spark, sf).headlines()
    txt = F.date_format("published_at", "yyyy-MM-dd'T'HH:mm:ss")
    return h.select("ticker", "relevancy", "source", txt.alias("published_text"), norm_date(txt).alias("date"),
                    date_text("date").alias("date_text"))


@register("jn_news_same_day", """
SELECT h.ticker, h.date, h.source, h.relevancy, round(p.close, 6) AS close
FROM headlines h JOIN prices5y p ON h.ticker = p.ticker AND h.date = p.date""", ("headlines", "prices5y"))
def q_jn_news_same_day(spark, sf):
    c = Ctx(spark, sf)
    j = NW.join_news_prices(c.headlines(), FE.ingest(c.bars()))
    return j.select("ticker", "date", "source", "relevancy", r6("close").alias("close"))


cte("next5y", ("prices5y",), """
SELECT ticker, date, close, lead(close) OVER (PARTITION BY ticker ORDER BY date) AS next_close FROM prices5y""")


@register("jn_next_trading_day", """
SELECT h.ticker, h.date, h.source, h.relevancy,
       round((CASE WHEN n.close <> 0 THEN n.next_close / n.close END - 1) * 100, 6) AS next_day_change
FROM headlines h JOIN next5y n ON h.ticker = n.ticker AND h.date = n.date
WHERE n.next_close IS NOT NULL""", ("headlines", "next5y"))
def q_jn_next_trading_day(spark, sf):
    c = Ctx(spark, sf)
    j = NW.next_day_change(c.headlines(), FE.ingest(c.bars()))
    return j.select("ticker", "date", "source", "relevancy", r6("next_day_change").alias("next_day_change"))


@register("sc_next_change_pct", """
SELECT ticker, date, round((CASE WHEN close <> 0 THEN next_close / close END - 1) * 100, 6) AS next_change_pct
FROM next5y""", ("next5y",))
def q_sc_next_change_pct(spark, sf):
    p = FE.ingest(Ctx(spark, sf).bars())
    p = p.select("ticker", "date", "close", F.lead("close").over(FE.W()).alias("nx"))
    return p.select("ticker", "date", r6(next_change_pct("close", "nx")).alias("next_change_pct"))


@register("jn_asof_next_day", """
SELECT h.ticker, h.date, h.source, h.relevancy, p.date AS next_date, round(p.close, 6) AS next_close
FROM headlines h ASOF LEFT JOIN prices5y p ON h.ticker = p.ticker AND p.date > h.date""",
          ("headlines", "prices5y"))
def q_jn_asof_next_day(spark, sf):
    c = Ctx(spark, sf)
    h = c.headlines().select("ticker", "date", "source", "relevancy")
    j = NW.asof_forward(h, FE.ingest(c.bars()))
    return j.select("ticker", "date", "source", "relevancy", "next_date", r6("next_close").alias("next_close"))


@register("jn_volatility_map", """
SELECT h.ticker, h.date, h.source, h.relevancy, coalesce(l.volatility, 'low') AS volatility
FROM headlines h LEFT JOIN levels3mo l ON h.ticker = l.ticker AND h.date = l.date""",
          ("headlines", "levels3mo"))
def q_jn_volatility_map(spark, sf):
    c = Ctx(spark, sf)
    lv = NW.volatility_levels(FE.ingest(c.bars(), "3mo"))
    return NW.attach_level(c.headlines(), lv).select("ticker", "date", "source", "relevancy", "volatility")


@register("jn_is_volatile", """
SELECT h.ticker, h.date, h.source, h.relevancy, coalesce(l.is_volatile, false) AS is_volatile
FROM headlines h LEFT JOIN (SELECT ticker, date, true AS is_volatile FROM levels3mo WHERE is_volatile) l
  ON h.ticker = l.ticker AND h.date = l.date""", ("headlines", "levels3mo"))
def q_jn_is_volatile(spark, sf):
    c = Ctx(spark, sf)
    lv = NW.volatility_levels(FE.ingest(c.bars(), "3mo"))
    return NW.flag_volatile(c.headlines(), lv).select("ticker", "date", "source", "relevancy", "is_volatile")


@register("pl_volatility_news", f"""
SELECT ticker, date, volatility, is_volatile, title, relevancy, CAST(quota AS BIGINT) AS quota FROM (
  SELECT h.ticker, h.date, l.volatility, l.is_volatile, h.title, h.relevancy,
         CASE l.volatility WHEN 'high' THEN 50 WHEN 'medium' THEN 25 ELSE 10 END AS quota,
         row_number() OVER (PARTITION BY h.ticker, h.date ORDER BY h.relevancy, h.title) AS rn
  FROM headlines h JOIN levels3mo l ON h.ticker = l.ticker AND h.date = l.date
  WHERE h.lang = 'en' AND l.date >= {ASOF_SQL} - 29)
WHERE rn <= quota""", ("headlines", "levels3mo", "bars"))
def q_pl_volatility_news(spark, sf):
    c = Ctx(spark, sf)
    return PL.pl_volatility_news(c.bars(), c.headlines())


@register("tk_news_quota", """
SELECT ticker, date, volatility, is_volatile, title, relevancy, CAST(quota AS BIGINT) AS quota FROM (
  SELECT h.ticker, h.date, l.volatility, l.is_volatile, h.title, h.relevancy,
         CASE WHEN l.is_volatile THEN 50 ELSE 10 END AS quota,
         row_number() OVER (PARTITION BY h.ticker, h.date ORDER BY h.relevancy, h.title) AS rn
  FROM headlines h JOIN (SELECT *, row_number() OVER (PARTITION BY ticker ORDER BY date DESC) AS r FROM levels3mo) l
    ON h.ticker = l.ticker AND h.date = l.date
  WHERE h.lang = 'en' AND l.r <= 5)
WHERE rn <= quota""", ("headlines", "levels3mo"))
def q_tk_news_quota(spark, sf):
    c = Ctx(spark, sf)
    return PL.pl_volatility_news(c.bars(), c.headlines(), mode="flag")


cte("companies", ("headlines",), """
SELECT ticker, arg_min(lower(split_part(title, ' ', 1)), (relevancy, source)) AS name FROM headlines GROUP BY ticker""")


@register("prj_news_query", r"""
SELECT h.ticker, h.source, h.relevancy,
       coalesce(contains(lower(h.title), lower(coalesce(c.name, h.ticker)))
                OR list_contains(regexp_extract_all(h.title, '\^?[\p{L}\p{N}_]+(?:[.\-=][\p{L}\p{N}_]+)*'), h.ticker)
                OR list_contains(regexp_extract_all(h.title, '[\p{L}\p{N}_]+'), h.ticker), false) AS matched
FROM headlines h LEFT JOIN companies c ON h.ticker = c.ticker""", ("headlines", "companies"))
def q_prj_news_query(spark, sf):
    h = Ctx(spark, sf).headlines()
    comp = h.groupBy("ticker").agg(
        F.min_by(F.lower(F.split("title", " ").getItem(0)), F.struct("relevancy", "source")).alias("name"))
    return NW.news_match(h, comp).select("ticker", "source", "relevancy", "matched")


_TOKENS = r"regexp_extract_all(lower({}), '[\p{{L}}\p{{N}}_]+')"


@register("prj_news_search", rf"""
SELECT h.source, h.relevancy, c.ticker
FROM headlines h JOIN (
  SELECT ticker, arg_min(list_slice({_TOKENS.format('title')}, 1, 2), (relevancy, source)) AS name FROM headlines
  WHERE len({_TOKENS.format('title')}) >= 2 GROUP BY ticker) c
ON contains(' ' || array_to_string({_TOKENS.format('h.title')}, ' ') || ' ', ' ' || array_to_string(c.name, ' ') || ' ')
  OR list_contains(regexp_extract_all(h.title, '\^?[\p{{L}}\p{{N}}_]+(?:[.\-=][\p{{L}}\p{{N}}_]+)*'), c.ticker)
  OR list_contains(regexp_extract_all(h.title, '[\p{{L}}\p{{N}}_]+'), c.ticker)""", ("headlines",))
def q_prj_news_search(spark, sf):
    """Headlines without their ticker, searched for every company: the first two words of a ticker's foremost title are its name."""
    h = Ctx(spark, sf).headlines()
    words = NW.name_tokens("title")
    names = h.where(F.size(words) >= 2).groupBy("ticker").agg(F.min_by(F.slice(words, 1, 2), F.struct("relevancy", "source")).alias("w"))
    got = NW.news_search(h, names.select("ticker", F.array_join("w", " ").alias("name")))
    return got.select("source", "relevancy", "ticker")


# ---------------------------------------------------------------------------
# labels (stand-in models as UDFs; the oracle computes them in SQL)
# ---------------------------------------------------------------------------

_LABEL_SQL = "['positive', 'negative', 'neutral'][('0x' || substr(md5(title), 1, 2))::INT % 3 + 1]"
_SCORE_SQL = "0.5 + (('0x' || substr(md5(title), 1, 2))::INT % 50) / 100.0"
_LINE_SQL = ("'- ' || " + render_sql(K.HEADLINE_LINE, title="title",
                                     label="upper(substr(" + _LABEL_SQL + ", 1, 1)) || substr(" + _LABEL_SQL + ", 2)",
                                     score=fmt2_sql(_SCORE_SQL)))


@register("ud_classify_headlines", f"""
SELECT ticker, source, relevancy, {_LABEL_SQL} AS label, round({_SCORE_SQL}, 6) AS score
FROM headlines WHERE title IS NOT NULL""", ("headlines",))
def q_ud_classify_headlines(spark, sf):
    h = Ctx(spark, sf).headlines().where(F.col("title").isNotNull())
    lab = M.classify(h, "title", "_l", SI.md5_classifier)
    return lab.select("ticker", "source", "relevancy", F.col("_l.label").alias("label"),
                      r6(F.col("_l.score")).alias("score"))


@register("sc_headline_line", f"""
SELECT ticker, source, relevancy, {_LINE_SQL} AS line FROM headlines WHERE title IS NOT NULL""", ("headlines",))
def q_sc_headline_line(spark, sf):
    h = Ctx(spark, sf).headlines().where(F.col("title").isNotNull())
    label, score = SI.md5_label_cols(F.col("title"))
    line = F.concat(F.lit("- "), render(K.HEADLINE_LINE, title="title", label=F.initcap(label), score=fmt2(score)))
    return h.select("ticker", "source", "relevancy", line.alias("line"))


@register("ag_collect_headlines", f"""
SELECT ticker, CAST(count(*) AS BIGINT) AS n_headlines,
       string_agg(line, chr(10) ORDER BY date, title, line) AS headline_block
FROM (SELECT ticker, date, title, {_LINE_SQL} AS line FROM (
        SELECT *, row_number() OVER (PARTITION BY ticker ORDER BY relevancy, title) AS rn FROM headlines
        WHERE lang = 'en' AND date >= {ASOF_SQL} - 5 AND date <= {ASOF_SQL})
      WHERE rn <= 20 AND title IS NOT NULL AND title <> '')
GROUP BY ticker""", ("headlines", "bars"))
def q_ag_collect_headlines(spark, sf):
    c = Ctx(spark, sf)
    s = NW.select_news(c.headlines(), asof=_asof(c), days=K.NEWS_LOOKBACK_DAYS, lang="en", cap=K.NEWS_CAP)
    return NW.headline_block(M.classify(s, "title", "_lab", SI.md5_classifier))


_LABEL_PROMPT_SQL = render_sql(K.LABEL_PROMPT, headline="coalesce(title, 'None')")
_H_SQL = f"('0x' || substr(md5({_LABEL_PROMPT_SQL}), 1, 4))::INT"


def _score_pair_sql(h: str) -> tuple[str, str]:
    score = f"CASE WHEN {h} % 4 = 0 THEN 0.0 ELSE CAST(printf('%.2f', (({h} % 201) - 100) / 100.0) AS DOUBLE) END"
    change = (f"CASE WHEN {h} % 4 = 0 THEN 0.0 ELSE CAST(printf('%.2f', ((({h}) // 201) % 1001 - 500) / 100.0) "
              f"AS DOUBLE) END")
    return score, change


_SC, _CH = _score_pair_sql("h")


@register("sc_label_prompt", f"""
SELECT ticker, source, relevancy, md5({_LABEL_PROMPT_SQL}) AS prompt_md5 FROM headlines""", ("headlines",))
def q_sc_label_prompt(spark, sf):
    h = Ctx(spark, sf).headlines()
    p = render(K.LABEL_PROMPT, headline=F.coalesce("title", F.lit("None")))
    return h.select("ticker", "source", "relevancy", F.md5(p).alias("prompt_md5"))


@register("ud_score_headlines", f"""
SELECT ticker, source, relevancy, round({_SC}, 6) AS sentiment_score, round({_CH}, 6) AS predicted_change
FROM (SELECT *, {_H_SQL} AS h FROM headlines)""", ("headlines",))
def q_ud_score_headlines(spark, sf):
    h = Ctx(spark, sf).headlines()
    h = h.withColumn("_p", render(K.LABEL_PROMPT, headline=F.coalesce("title", F.lit("None"))))
    h = M.generate(h, "_p", "_a", SI.md5_scorer)
    s, c = parse_label_pair("_a")
    return h.select("ticker", "source", "relevancy", r6(s).alias("sentiment_score"), r6(c).alias("predicted_change"))


def _scorer_answer_cols(prompt_col):
    """The md5_scorer stand-in written with SQL functions (no UDF)."""
    h = F.conv(F.substr(F.md5(prompt_col), F.lit(1), F.lit(4)), 16, 10).cast("int")
    score = ((h % 201) - 100) / 100.0
    change = (F.floor(h / 201) % 1001 - 500) / 100.0
    dec = F.concat(F.lit("SENTIMENT_SCORE: "), fmt2(score), F.lit(", NEXT_DAY_PRICE_CHANGE: "), fmt2(change), F.lit("%"))
    ints = F.concat(F.lit("SENTIMENT_SCORE: "), score.cast("int").cast("string"), F.lit(", NEXT_DAY_PRICE_CHANGE: "),
                    change.cast("int").cast("string"), F.lit("%"))
    return F.when(h % 4 == 0, ints).otherwise(dec)


@register("sc_parse_label_pair", f"""
SELECT ticker, source, relevancy, round({_SC}, 6) AS sentiment_score, round({_CH}, 6) AS predicted_change
FROM (SELECT *, {_H_SQL} AS h FROM headlines)""", ("headlines",))
def q_sc_parse_label_pair(spark, sf):
    h = Ctx(spark, sf).headlines()
    ans = _scorer_answer_cols(render(K.LABEL_PROMPT, headline=F.coalesce("title", F.lit("None"))))
    s, c = parse_label_pair(ans)
    return h.select("ticker", "source", "relevancy", r6(s).alias("sentiment_score"), r6(c).alias("predicted_change"))


_SAMPLE_SQL = render_sql(K.SENTIMENT_SAMPLE, headline="coalesce(title, 'None')", score=fmt2_sql("score"),
                         change=fmt2_sql("chg"))


@register("sc_sentiment_prompt", f"""
SELECT ticker, date, source, relevancy, {_SAMPLE_SQL} AS text
FROM (SELECT h.*, {_score_pair_sql('hh')[0]} AS score,
             (CASE WHEN n.close <> 0 THEN n.next_close / n.close END - 1) * 100 AS chg
      FROM (SELECT *, {_H_SQL} AS hh FROM headlines) h JOIN next5y n ON h.ticker = n.ticker AND h.date = n.date
      WHERE n.next_close IS NOT NULL)""", ("headlines", "next5y"))
def q_sc_sentiment_prompt(spark, sf):
    c = Ctx(spark, sf)
    j = NW.next_day_change(c.headlines(), FE.ingest(c.bars()))
    ans = _scorer_answer_cols(render(K.LABEL_PROMPT, headline=F.coalesce("title", F.lit("None"))))
    s, _ = parse_label_pair(ans)
    text = render(K.SENTIMENT_SAMPLE, headline=F.coalesce("title", F.lit("None")), score=fmt2(s),
                  change=fmt2("next_day_change"))
    return j.select("ticker", "date", "source", "relevancy", text.alias("text"))


cte("order3", ("portfolio",), """
SELECT ticker, min(order_no) AS order_no FROM (
  SELECT ticker, idx * 2 + CASE WHEN side = 'volatile' THEN 0 ELSE 1 END AS order_no FROM (
    SELECT *, CASE WHEN side = 'volatile' THEN row_number() OVER (PARTITION BY side ORDER BY pos)
                   ELSE row_number() OVER (PARTITION BY side ORDER BY pos DESC) END - 1 AS idx,
           count(*) FILTER (WHERE side = 'volatile') OVER () AS nv
    FROM portfolio)
  WHERE side = 'volatile' OR idx < nv)
GROUP BY ticker""")

cte("next3mo", ("prices3mo",), """
SELECT ticker, date, close, lead(close) OVER (PARTITION BY ticker ORDER BY date) AS next_close FROM prices3mo""")


@register("pl_sentiment_corpus", f"""
SELECT ticker, CAST(order_no AS BIGINT) AS order_no, date, relevancy, round(score, 6) AS sentiment_score,
       round(chg, 6) AS next_day_change, md5({_SAMPLE_SQL}) AS text_md5
FROM (SELECT h.ticker, o.order_no, h.date, h.relevancy, h.title,
             {_score_pair_sql('hh')[0]} AS score,
             (CASE WHEN n.close <> 0 THEN n.next_close / n.close END - 1) * 100 AS chg
      FROM (SELECT *, {_H_SQL} AS hh FROM (
              SELECT *, row_number() OVER (PARTITION BY ticker ORDER BY relevancy, title) AS rn FROM headlines
              WHERE lang = 'en' AND date >= {ASOF_SQL} - 30)
            WHERE rn <= 100) h
      JOIN order3 o ON h.ticker = o.ticker
      JOIN next3mo n ON h.ticker = n.ticker AND h.date = n.date
      WHERE n.next_close IS NOT NULL)""", ("headlines", "order3", "next3mo", "bars"))
def q_pl_sentiment_corpus(spark, sf):
    c = Ctx(spark, sf)
    s = PL.pl_sentiment_corpus(c.bars(), c.headlines(), SI.md5_scorer)
    return s.select("ticker", F.col("order_no").cast("bigint").alias("order_no"), "date", "relevancy",
                    r6("sentiment_score").alias("sentiment_score"), r6("next_day_change").alias("next_day_change"),
                    F.md5("text").alias("text_md5"))


@register("sc_summary_trim", """
SELECT ticker, source, relevancy,
       CASE WHEN strpos(title, ',') > 0
            THEN regexp_replace(substr(title, strpos(title, ',') + 1), '^\\s+|\\s+$', '', 'g') ELSE title END AS trimmed
FROM headlines""", ("headlines",))
def q_sc_summary_trim(spark, sf):
    h = Ctx(spark, sf).headlines()
    return h.select("ticker", "source", "relevancy", summary_trim("title").alias("trimmed"))
