"""Host-level quality rules, in DataFrame functions only.

Each document is measured and held against simple rules. Rule failures are counted by host, the
hosts' failure rates are shrunk towards an empirical beta prior, and each host's verdict goes back
to its documents.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lexspark.llm.common import SPACES, checkpoint, read

#: Columns that ``measure`` adds.
MEASURES = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")
#: A document fails a rule where its condition holds. ``short`` and ``repeats`` alone reject it.
RULES = {
    "short": "n_words < 20",
    "repeats": "100 * n_repeat_words > 30 * n_words",
    "symbols": "10 * n_symbols > n_words",
    "dup_lines": "n_dup_lines > 5 AND 20 * n_dup_lines > n_words",
    "word_length": "word_chars > 12 * n_words OR word_chars < 2 * n_words",
}
#: A host is rejected where the shrunken rate of any rule is above this.
HOST_LIMIT = 0.6
#: The prior counts as at most so many documents.
MAX_STRENGTH = 10_000.0
#: A table of hosts up to this many rows is broadcast (some 100 bytes each); a larger one is joined by salted keys.
BROADCAST_HOSTS = 100_000
SALTS = 32


def measure(docs: DataFrame, text: str = "text") -> DataFrame:
    """Add the measures of each whole text; a null text counts as one without words.

    All work is on the row's own arrays, so nothing is shuffled. A word counts as repeated if it
    lies in an 8-word window that is found twice or more in the text (windows are compared by
    64-bit hashes).
    """
    body = F.coalesce(F.col(text), F.lit(""))
    keep = docs.columns
    at = lambda a, i: F.get(a, i)
    df = docs.select(
        "*",
        F.array_remove(F.split(body, r"[\x20\x09-\x0D]+"), "").alias("_words"),
        F.filter(F.split(body, "\n"), lambda x: F.length(F.btrim(x, F.lit(SPACES))) > 0).alias("_lines"),
        (F.length(body) - F.length(F.regexp_replace(body, r"[#*$%&|<>]", ""))).cast("long").alias("n_symbols"),
    )
    df = df.select(
        *keep,
        "n_symbols",
        F.size("_words").cast("long").alias("n_words"),
        F.length(F.array_join("_words", "")).cast("long").alias("word_chars"),
        (F.size("_lines") - F.size(F.array_distinct("_lines"))).cast("long").alias("n_dup_lines"),
        F.transform("_words", lambda w: F.xxhash64(w)).alias("_hashes"),
    )
    windows = F.when(
        F.col("n_words") >= 8,
        F.transform(
            F.sequence(F.lit(0), (F.col("n_words") - 8).cast("int")),
            lambda i: F.xxhash64(*[at(F.col("_hashes"), i + k) for k in range(8)])
        ),
    ).otherwise(F.array().cast("array<bigint>"))
    df = df.select(*keep, "n_symbols", "n_words", "word_chars", "n_dup_lines", windows.alias("_windows"))
    df = df.withColumn("_twice", F.size(F.array_distinct("_windows")) < F.size("_windows"))
    ordered = F.when(F.col("_twice"), F.sort_array(F.transform("_windows", lambda h, i: F.struct(h.alias("h"), i.alias("i")))))
    df = df.select(*keep, "n_symbols", "n_words", "word_chars", "n_dup_lines", ordered.alias("_ordered"))
    same = lambda i, j: at(F.col("_ordered"), i)["h"].eqNullSafe(at(F.col("_ordered"), j)["h"])  # noqa: E731  null outside the array
    starts = F.when(
        F.col("_ordered").isNotNull(),
        F.sort_array(F.transform(
            F.filter(F.sequence(F.lit(0), F.size("_ordered") - 1), lambda i: same(i, i - 1) | same(i, i + 1)),
            lambda i: at(F.col("_ordered"), i)["i"]
        )),
    )
    df = df.select(*keep, "n_symbols", "n_words", "word_chars", "n_dup_lines", starts.alias("_starts"))
    covered = F.aggregate(
        "_starts",
        F.struct(F.lit(-8).alias("last"), F.lit(0).cast("long").alias("n")),
        lambda a, x: F.struct(x.alias("last"), (a["n"] + F.least(F.lit(8), x - a["last"])).alias("n")),
        lambda a: a["n"],
    )
    return df.select(
        *keep, "n_words", "word_chars", "n_symbols", "n_dup_lines",
        F.coalesce(covered, F.lit(0).cast("long")).alias("n_repeat_words")
    )


def host_verdicts(measured: DataFrame, host: str = "host") -> DataFrame:
    """One row for each host: documents, failures and shrunken rate of each rule, host_ok.

    The prior of a rule is a beta distribution with the mean of all documents and the strength
    that the spread of the hosts' rates gives (method of moments, 1 to MAX_STRENGTH documents).
    Hosts are few beside documents; partial sums leave each task before the shuffle, so a host
    with a third of all rows costs no more than others. One row, the priors, goes to the driver.
    A null host is a host of its own.
    """
    hosts = checkpoint(measured.groupBy(F.col(host)).agg(
        F.count(F.lit(1)).alias("n_docs"),
        *[F.sum(F.expr(f"CAST({c} AS INT)")).cast("long").alias(f"fails_{r}") for r, c in RULES.items()]
    ))
    moments = hosts.agg(
        *[F.expr(f"CAST(sum(fails_{r}) AS DOUBLE) / sum(n_docs)").alias(f"m_{r}") for r in RULES],
        *[F.expr(f"var_pop(CAST(fails_{r} AS DOUBLE) / n_docs)").alias(f"v_{r}") for r in RULES],
    ).first()
    rates = {}
    for r in RULES:
        m, v = moments[f"m_{r}"] or 0.0, moments[f"v_{r}"] or 0.0
        strength = min(MAX_STRENGTH, max(1.0, m * (1 - m) / v - 1)) if v > 0 else MAX_STRENGTH
        rates[f"rate_{r}"] = (F.col(f"fails_{r}") + F.lit(m * strength)) / (F.col("n_docs") + F.lit(strength))
    return hosts.withColumns(rates).withColumn("host_ok", F.greatest(*[F.col(c) for c in rates]) <= HOST_LIMIT)


def quality_rules(docs: DataFrame, host: str = "source", text: str = "text", key: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """Measures and verdict of each document: key columns, MEASURES, base_failed, host_ok, kept.

    One row for each input row, repeated rows included. A text that is null or empty has no words
    and so fails. Only key, host and text are read: other columns of any name don't matter. An
    empty table gives an empty result. The measures are kept in a checkpoint (some 100 bytes a
    document), as both the hosts' counts and the join read them.
    """
    named = docs.select(
        *[F.col(c).alias(f"_key{i}") for i, c in enumerate(key)], F.col(host).alias("host"), F.col(text).alias("_text")
    )
    measured = checkpoint(measure(named, "_text").drop("_text"))
    hosts = checkpoint(host_verdicts(measured).select("host", "host_ok"))
    joined = _with_verdict(measured, hosts, "_key0")
    failed = F.expr(f"({RULES['short']}) OR ({RULES['repeats']})")
    return joined.select(
        *[F.col(f"_key{i}").alias(c) for i, c in enumerate(key)], *MEASURES, failed.alias("base_failed"), "host_ok",
        (~failed & F.col("host_ok")).alias("kept")
    )


def keep_good(docs: DataFrame, host: str = "source", text: str = "text") -> DataFrame:
    """The rows that are kept, with their own columns of any name; all other behaviour is that of ``quality_rules``.

    The texts are measured twice, for the hosts' counts and for the rows, rather than moved or stored.
    """
    measured = measure(
        docs.select(
            F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("_row"), F.col(host).alias("host"),
            F.col(text).alias("_text")
        ),
        "_text"
    )
    # rules on what a generator gives are not pushed below it, where the measures would be worked out once for each mention
    measured = measured.select("_row", "host", F.explode(F.array(F.struct(*MEASURES))).alias("_m")).select("_row", "host", "_m.*")
    hosts = checkpoint(host_verdicts(measured.select("host", *MEASURES)).select("host", "host_ok"))
    failed = F.expr(f"({RULES['short']}) OR ({RULES['repeats']})")
    return _with_verdict(
        measured.where(~failed).select("_row", "host", *MEASURES), hosts, "_row"
    ).where("host_ok").select("_row.*")


def _with_verdict(rows: DataFrame, hosts: DataFrame, salt_by: str) -> DataFrame:
    """The rows with host_ok: a small table of hosts is broadcast, a larger one joined by salted keys."""
    if hosts.count() <= BROADCAST_HOSTS:
        return rows.alias("m").join(
            F.broadcast(hosts.alias("h")), F.col("m.host").eqNullSafe(F.col("h.host")), "left"
        ).select("m.*", "host_ok")
    salted = rows.withColumn("_salt", F.pmod(F.xxhash64(salt_by, *MEASURES), F.lit(SALTS)).cast("int"))
    spread = hosts.withColumn("_salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    return salted.alias("m").join(
        spread.alias("h"), F.col("m.host").eqNullSafe(F.col("h.host")) & (F.col("m._salt") == F.col("h._salt")), "left"
    ).select("m.*", "host_ok")


def op1_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """See ``quality_rules``: nulls count as empty texts and as a host of their own, repeated rows give a row each."""
    return quality_rules(read(spark, sf_dir, "documents"))


ORACLE_SQL = r"""
WITH d AS (
  SELECT row_number() OVER () AS rid, doc_id, source, coalesce(text, '') AS t FROM documents
), w AS (
  SELECT rid, doc_id, source, t, regexp_extract_all(t, '[^\x20\x09-\x0D]+') AS ws FROM d
), wins AS (
  SELECT rid, i, array_to_string(list_slice(ws, i, i + 7), ' ') AS g
  FROM (SELECT rid, ws, unnest(range(1, len(ws) - 6)) AS i FROM w WHERE len(ws) >= 8)
), twice AS (
  SELECT rid, i FROM (SELECT rid, i, count(*) OVER (PARTITION BY rid, g) AS n FROM wins) WHERE n > 1
), gaps AS (
  SELECT rid, least(8, i - coalesce(lag(i) OVER (PARTITION BY rid ORDER BY i), i - 8)) AS g FROM twice
), reps AS (
  SELECT rid, sum(g) AS n FROM gaps GROUP BY rid
), lines AS (
  SELECT rid, unnest(string_split(t, chr(10))) AS l FROM d
), dups AS (
  SELECT rid, count(*) - count(DISTINCT l) AS n FROM lines WHERE regexp_matches(l, '[^\x20\x09-\x0D]') GROUP BY rid
), m AS (
  SELECT w.rid, doc_id, source, CAST(len(ws) AS BIGINT) AS n_words,
         CAST(length(array_to_string(ws, '')) AS BIGINT) AS word_chars,
         CAST(length(t) - length(regexp_replace(t, '[#*$%&|<>]', '', 'g')) AS BIGINT) AS n_symbols,
         CAST(coalesce(dups.n, 0) AS BIGINT) AS n_dup_lines, CAST(coalesce(reps.n, 0) AS BIGINT) AS n_repeat_words
  FROM w LEFT JOIN dups ON dups.rid = w.rid LEFT JOIN reps ON reps.rid = w.rid
), hosts AS (
  SELECT source, count(*) AS n_docs, __FAILS__ FROM m GROUP BY source
), prior AS (
  SELECT __MOMENTS__ FROM hosts
), strength AS (
  SELECT *, __STRENGTHS__ FROM prior
), verdict AS (
  SELECT source, greatest(__RATES__) <= __LIMIT__ AS host_ok FROM hosts, strength
)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words,
       (n_words < 20 OR 100 * n_repeat_words > 30 * n_words) AS base_failed, host_ok,
       NOT (n_words < 20 OR 100 * n_repeat_words > 30 * n_words) AND host_ok AS kept
FROM m LEFT JOIN verdict ON m.source IS NOT DISTINCT FROM verdict.source
"""
for _mark, _sql in {
    "__FAILS__": ", ".join(f"count(*) FILTER (WHERE {c}) AS fails_{r}" for r, c in RULES.items()),
    "__MOMENTS__": ", ".join(f"CAST(sum(fails_{r}) AS DOUBLE) / sum(n_docs) AS m_{r}, var_pop(CAST(fails_{r} AS DOUBLE) / "
    f"n_docs) AS v_{r}" for r in RULES),
    "__STRENGTHS__": ", ".join(f"CASE WHEN v_{r} > 0 THEN least({MAX_STRENGTH}, greatest(1.0, m_{r} * (1 - m_{r}) / v_{r} - 1)) "
    f"ELSE {MAX_STRENGTH} END AS s_{r}" for r in RULES),
    "__RATES__": ", ".join(f"(fails_{r} + m_{r} * s_{r}) / (n_docs + s_{r})" for r in RULES),
    "__LIMIT__": str(HOST_LIMIT),
}.items():
    ORACLE_SQL = ORACLE_SQL.replace(_mark, _sql)
