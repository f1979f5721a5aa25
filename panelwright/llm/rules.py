"""Quality rules: a threshold table compiled into one native projection.

Every metric is a Catalyst expression over one row, so the plan is a scan and
a projection: no shuffle, no Python, and a hot source or long text costs only
its own length.  Null texts count as empty, so they fail the base rule; repeated
rows give repeated results; a clashing input column is not read.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import WORD, let, words

#: Frequent function words of English, French, German and Spanish.
STOP_WORDS = (
    "the be to of and that have with in is was it for on are as by from at this "
    "le la les des de du et un une que qui en est pour dans par sur au "
    "der die das und ist von mit ein eine zu den nicht sich auf für auch "
    "el los las y es una por con se lo su para al"
).split()


@dataclass(frozen=True)
class Rule:
    """Keep a row when ``low * base <= 1000 * metric <= high * base`` (base 1 without ``per``)."""

    name: str
    metric: str
    per: str | None
    low: int | None
    high: int | None


#: Ratios in thousandths, so that every comparison is between integers.
RULES = (
    Rule("length", "n_words", None, 50_000, None),
    Rule("word_length", "word_chars", "n_words", 1_500, 16_000),
    Rule("symbols", "n_symbols", "n_words", None, 100),
    Rule("shouts", "n_shouts", "n_words", None, 300),
    Rule("stop_words", "n_stop_words", "n_words", 20, None),
    Rule("repeated_lines", "n_dup_lines", "n_lines", None, 300),
)


def repeat_words(found: Column) -> Column:
    """Words that lie in a three-word window found twice or more.

    Windows are compared by 64-bit hashes chained over the three words; only
    texts whose hashes are not all distinct are sorted.
    """

    def sorted_windows(pairs: Column) -> Column:
        same = lambda x, i: ((i > 0) & (pairs[i - 1]["h"] == x["h"])) | (
            (i + 1 < F.size(pairs)) & (pairs[i + 1]["h"] == x["h"])
        )
        starts = F.transform(F.filter(pairs, same), lambda x: x["i"])
        return let(
            starts,
            lambda s: F.size(F.array_distinct(F.concat(s, F.transform(s, lambda p: p + 1), F.transform(s, lambda p: p + 2)))),
        )

    def windows(w: Column) -> Column:
        hashes = F.transform(F.sequence(F.lit(2), F.size(w) - 1), lambda i: F.xxhash64(w[i - 2], w[i - 1], w[i]))
        return let(
            hashes,
            lambda h: F.when(F.size(F.array_distinct(h)) == F.size(h), F.lit(0)).otherwise(
                let(F.sort_array(F.transform(h, lambda x, i: F.struct(x.alias("h"), i.alias("i")))), sorted_windows)
            ),
        )

    return F.when(F.size(found) < 4, F.lit(0)).otherwise(windows(found))


def metrics(text: Column) -> Column:
    """All metrics of a text as one struct of longs."""
    text = F.coalesce(text, F.lit(""))
    lines = F.filter(F.split(text, "\n"), lambda x: x.rlike(WORD))
    stops = sorted({f for w in STOP_WORDS for f in (w, w.capitalize(), w.upper())})

    def of(w: Column) -> Column:
        return F.struct(
            F.size(w).cast("long").alias("n_words"),
            F.length(F.array_join(w, "")).cast("long").alias("word_chars"),
            F.length(F.regexp_replace(text, r"[^#*$%&|<>]+", "")).cast("long").alias("n_symbols"),
            let(lines, lambda x: F.struct(F.size(x).alias("n"), (F.size(x) - F.size(F.array_distinct(x))).alias("dup"))).alias("lines"),
            repeat_words(w).cast("long").alias("n_repeat_words"),
            F.size(F.filter(w, lambda x: x.isin(stops))).cast("long").alias("n_stop_words"),
            F.size(F.filter(w, lambda x: x.endswith("!!"))).cast("long").alias("n_shouts"),
        )

    return let(words(text), of)


def compile_rules(rules=RULES) -> dict[str, Column]:
    """Each rule as a boolean expression over the metric columns."""
    out = {}
    for r in rules:
        base = F.lit(1) if r.per is None else F.col(r.per)
        ok = F.lit(True)
        if r.low is not None:
            ok = ok & (1000 * F.col(r.metric) >= r.low * base)
        if r.high is not None:
            ok = ok & (1000 * F.col(r.metric) <= r.high * base)
        out[r.name] = ok
    return out


def quality_rules(docs: DataFrame, rules=RULES, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per document: metrics, ``base_failed``, one flag per rule, ``kept``."""
    m = docs.select(F.col(id_col).alias("doc_id"), metrics(F.col(text_col)).alias("m"))
    flat = m.select(
        "doc_id",
        *[F.col(f"m.{c}").alias(c) for c in ("n_words", "word_chars", "n_symbols")],
        F.col("m.lines.dup").cast("long").alias("n_dup_lines"),
        F.col("m.n_repeat_words").alias("n_repeat_words"),
        F.col("m.lines.n").cast("long").alias("n_lines"),
        F.col("m.n_stop_words").alias("n_stop_words"),
        F.col("m.n_shouts").alias("n_shouts"),
    )
    compiled = compile_rules(rules)
    failed = (F.col("n_words") < 50) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words"))
    kept = ~failed
    for ok in compiled.values():
        kept = kept & ok
    return flat.select("*", failed.alias("base_failed"), *[ok.alias(f"ok_{n}") for n, ok in compiled.items()], kept.alias("kept"))


def rules_sql(rules=RULES) -> str:
    """The default operator's rows in DuckDB SQL."""
    cond = []
    for r in rules:
        base = r.per or "1"
        parts = [f"1000 * {r.metric} >= {r.low} * {base}"] * (r.low is not None) + [f"1000 * {r.metric} <= {r.high} * {base}"] * (r.high is not None)
        cond.append((r.name, " AND ".join(parts)))
    stops = ", ".join(f"'{f}'" for f in sorted({f for w in STOP_WORDS for f in (w, w.capitalize(), w.upper())}))
    return f"""
WITH d AS (
  SELECT doc_id, coalesce(text, '') AS t, regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+') AS w,
         list_filter(string_split(coalesce(text, ''), chr(10)), lambda x: regexp_matches(x, '[^\\x20\\x09-\\x0D]')) AS ln
  FROM documents),
g AS (SELECT doc_id, unnest(range(1, len(w) - 1)) AS i, w FROM d WHERE len(w) >= 3),
g3 AS (SELECT doc_id, i, w[i] AS a, w[i + 1] AS b, w[i + 2] AS c FROM g),
r AS (SELECT doc_id, i FROM (SELECT doc_id, i, count(*) OVER (PARTITION BY doc_id, a, b, c) AS k FROM g3) WHERE k > 1),
cov AS (SELECT doc_id, count(DISTINCT i + o) AS n FROM r, (SELECT unnest([0, 1, 2]) AS o) GROUP BY doc_id),
m AS (
  SELECT d.doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(length(list_aggregate(list_concat([''], w), 'string_agg', '')) AS BIGINT) AS word_chars,
         CAST(length(regexp_replace(t, '[^#*$%&|<>]+', '', 'g')) AS BIGINT) AS n_symbols,
         CAST(len(ln) - len(list_distinct(ln)) AS BIGINT) AS n_dup_lines, CAST(coalesce(cov.n, 0) AS BIGINT) AS n_repeat_words,
         CAST(len(ln) AS BIGINT) AS n_lines,
         CAST(len(list_filter(w, lambda x: x IN ({stops}))) AS BIGINT) AS n_stop_words,
         CAST(len(list_filter(w, lambda x: ends_with(x, '!!'))) AS BIGINT) AS n_shouts
  FROM d LEFT JOIN cov ON d.doc_id = cov.doc_id),
b AS (SELECT *, n_words < 50 OR 100 * n_repeat_words > 50 * n_words AS base_failed FROM m)
SELECT *, {", ".join(f"({c}) AS ok_{n}" for n, c in cond)},
       NOT base_failed AND {" AND ".join(f"({c})" for _, c in cond)} AS kept
FROM b"""
