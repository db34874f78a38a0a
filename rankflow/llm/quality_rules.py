"""Quality rules per document and per host.

Each document is measured in one pass; failures of every rule are summed by host, each host's rate is shrunk with a beta
prior fitted to all hosts by moments, and a host whose shrunken rate of any rule passes the limit is rejected as a whole.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StructField, StructType

from rankflow.llm.common import looked_up, materialize, prepare, site, without

SYMBOLS = "#*$%&|<>"
MEASURES = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")
#: A host is rejected when the shrunken share of its documents that fail one rule is above this.
HOST_LIMIT = 0.9
#: Bounds of the beta prior's weight, in documents.
PRIOR_DOCUMENTS = (2.0, 1000.0)


def measure(text: str) -> tuple[int, int, int, int, int]:
    """The measures of one text, in the order of ``MEASURES``."""
    words = text.encode().split()
    chars = len(text) - sum(map(text.count, " \t\n\r\x0b\x0c"))
    lines = [line for line in text.split("\n") if line.strip(" \t\r\x0b\x0c")]
    return len(words), chars, sum(map(text.count, SYMBOLS)), len(lines) - len(set(lines)), _repeated(words)


def _repeated(words: list[bytes]) -> int:
    """Words in three-word windows that are found twice or more."""
    if len(words) < 4:
        return 0
    numbers: dict[bytes, int] = {}
    at = np.fromiter((numbers.setdefault(w, len(numbers)) for w in words), dtype=np.int64, count=len(words))
    pairs = np.unique(at[:-1] * len(numbers) + at[1:], return_inverse=True)[1]
    _, kind, count = np.unique(pairs[:-1] * len(numbers) + at[2:], return_inverse=True, return_counts=True)
    hit = count[kind] > 1
    covered = np.zeros(len(words), dtype=bool)
    for shift in range(3):
        covered[shift : len(words) - 2 + shift] |= hit
    return int(covered.sum())


def rules() -> dict[str, Column]:
    """A document's failures; the first two are final for the document itself."""
    n = F.col("n_words")
    return {
        "few_words": n < 50,
        "repeats": F.col("n_repeat_words") * 100 > n * 50,
        "symbols": F.col("n_symbols") * 2 > n,
        "long_words": F.col("word_chars") > n * 15,
    }


def measured(documents: DataFrame, keep: list[Column], text_col: str = "text") -> DataFrame:
    """The columns ``keep`` and the measures of every whole text; null counts as empty."""
    prepare(documents.sparkSession)
    source = documents.select(*keep, documents[text_col].alias("_text"))
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in source.schema if f.name != "_text") + "".join(f", {m} bigint" for m in MEASURES)

    def run(batches):
        for batch in batches:
            *kept, texts = batch.columns
            found = np.array([measure(t.as_py() or "") for t in texts], dtype=np.int64).reshape(-1, len(MEASURES))
            yield pa.RecordBatch.from_arrays([*kept, *(pa.array(found[:, i]) for i in range(len(MEASURES)))], names=[*batch.schema.names[:-1], *MEASURES])

    return source.mapInArrow(run, schema)


def host_rates(measures: DataFrame, host: str) -> DataFrame:
    """Per host: documents, and each rule's failures and shrunken rate ``rate_<rule>``; hosts that are null are left out."""
    names = list(rules())
    hosts = measures.filter(F.col(host).isNotNull()).groupBy(host).agg(F.count(F.lit(1)).alias("documents"), *(F.sum(c.cast("long")).alias(f"failed_{k}") for k, c in rules().items()))
    rate = lambda k: F.col(f"failed_{k}") / F.col("documents")
    low, high = PRIOR_DOCUMENTS
    moments = hosts.agg(*(F.avg(rate(k)).alias(f"mean_{k}") for k in names), *(F.var_pop(rate(k)).alias(f"var_{k}") for k in names))
    moments = moments.select(
        *(f"mean_{k}" for k in names),
        *(F.when(F.col(f"var_{k}") > 0, F.greatest(F.lit(low), F.least(F.lit(high), F.col(f"mean_{k}") * (1 - F.col(f"mean_{k}")) / F.col(f"var_{k}") - 1))).otherwise(F.lit(high)).alias(f"weight_{k}") for k in names),
    )
    shrunk = hosts.crossJoin(F.broadcast(moments))  # one row
    return shrunk.select(host, "documents", *(f"failed_{k}" for k in names), *((F.col(f"failed_{k}") + F.col(f"mean_{k}") * F.col(f"weight_{k}")).__truediv__(F.col("documents") + F.col(f"weight_{k}")).alias(f"rate_{k}") for k in names))


def rejected_hosts(measures: DataFrame, host: str, host_limit: float = HOST_LIMIT) -> DataFrame:
    return host_rates(measures, host).filter(F.greatest(*(F.col(f"rate_{k}") for k in rules())) > host_limit).select(host)


def _domain(source: Column) -> Column:
    """The domain of a source; null if it has none."""
    host, _ = site(source.cast("string"))
    return F.when(host != "", host)


def judge(documents: DataFrame, id_col: str = "doc_id", host_col: str = "source", text_col: str = "text", host_limit: float = HOST_LIMIT) -> DataFrame:
    """Measures and verdicts, one row per row of ``documents``.

    Columns: ``doc_id``, the measures, ``base_failed``, ``host_rejected``, ``kept``. A null text has no words and so
    fails; the host is the domain of ``host_col``, a URL or a mere name, and one that is null or empty is never rejected;
    repeated rows are repeated and count in their host; texts of any length are measured whole; a rate at the limit is no
    failure; an empty table gives an empty result; other columns are ignored, so clashing names do no harm.
    """
    return verdicts(materialize(measured(documents, [documents[id_col].alias("doc_id"), _domain(documents[host_col]).alias("host")], text_col), "measures"), "host", host_limit).drop("host")


def verdicts(measures: DataFrame, host: str, host_limit: float = HOST_LIMIT) -> DataFrame:
    """``measures`` with ``base_failed``, ``host_rejected`` and ``kept``."""
    bad = rejected_hosts(measures, host, host_limit).withColumn("_bad", F.lit(True))
    base = rules()["few_words"] | rules()["repeats"]
    joined = looked_up(measures, [host], bad)
    return joined.select(*measures.columns, base.alias("base_failed"), F.coalesce("_bad", F.lit(False)).alias("host_rejected")).withColumn("kept", ~F.col("base_failed") & ~F.col("host_rejected"))


def keep_good(documents: DataFrame, host_col: str = "source", text_col: str = "text") -> DataFrame:
    """The rows of ``documents`` that ``judge`` keeps, with all their columns.

    Rows are written once with their measures; the rows of rejected hosts are then left out. A null text has no words
    and goes; a row without a host is judged by itself; repeated rows stay or go together; an empty table stays empty;
    columns may have any names.
    """
    prepare(documents.sparkSession)
    whole = documents.select(F.struct(*(F.col(f"`{c}`") for c in documents.columns)).alias("document"))
    schema = StructType([whole.schema["document"], *(StructField(m, LongType()) for m in MEASURES)])
    text = documents.columns.index(text_col)

    def run(batches):
        for batch in batches:
            rows = batch.column(0)
            found = np.array([measure(t.as_py() or "") for t in rows.field(text)], dtype=np.int64).reshape(-1, len(MEASURES))
            yield pa.RecordBatch.from_arrays([rows, *(pa.array(found[:, i]) for i in range(len(MEASURES)))], names=schema.names)

    rows = materialize(whole.mapInArrow(run, schema), "measured").withColumn("host", _domain(F.col(f"document.`{host_col}`")))
    bad = materialize(rejected_hosts(rows.select("host", *MEASURES), "host").withColumnRenamed("host", "bad"), "hosts")
    passing = rows.filter(~(rules()["few_words"] | rules()["repeats"]))
    return without(passing, [F.col("host")], bad, [F.col("bad")], F.col("host") == F.col("bad")).select("document.*")


ORACLE_SQL = r"""
WITH d AS (SELECT row_number() OVER () AS rid, doc_id, nullif(lower(regexp_replace(regexp_extract(regexp_replace(trim(source), '^[A-Za-z][A-Za-z0-9+.-]*://', ''), '^([^/?#]*)', 1), '^(?:[^@]*@)?(?:www\.)?|:[0-9]*$', '', 'g')), '') AS source, coalesce(text, '') AS text FROM documents),
w AS (SELECT rid, doc_id, source, text, regexp_extract_all(text, '[^\x20\x09-\x0D]+') AS words, string_split(text, chr(10)) AS lines FROM d),
t AS (SELECT rid, unnest(range(1, len(words) - 1)) AS i, words FROM w WHERE len(words) >= 3),
g AS (SELECT rid, i, words[i] || ' ' || words[i + 1] || ' ' || words[i + 2] AS gram FROM t),
r AS (SELECT rid, i FROM (SELECT rid, i, count(*) OVER (PARTITION BY rid, gram) AS c FROM g) WHERE c > 1),
cov AS (SELECT rid, count(DISTINCT i + k) AS n FROM r, (VALUES (0), (1), (2)) AS s(k) GROUP BY rid),
m AS (
  SELECT w.rid, doc_id, source, CAST(len(words) AS BIGINT) AS n_words,
    CAST(coalesce(list_sum(list_transform(words, lambda x: length(x))), 0) AS BIGINT) AS word_chars,
    CAST(length(regexp_replace(text, '[^#*$%&|<>]', '', 'g')) AS BIGINT) AS n_symbols,
    CAST(len(list_filter(lines, lambda x: regexp_matches(x, '[^\x20\x09-\x0D]'))) - len(list_distinct(list_filter(lines, lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')))) AS BIGINT) AS n_dup_lines,
    CAST(coalesce(cov.n, 0) AS BIGINT) AS n_repeat_words
  FROM w LEFT JOIN cov ON w.rid = cov.rid),
f AS (SELECT *, n_words < 50 AS f1, n_repeat_words * 100 > n_words * 50 AS f2, n_symbols * 2 > n_words AS f3, word_chars > n_words * 15 AS f4 FROM m),
h AS (SELECT source, CAST(count(*) AS DOUBLE) AS n, unnest([1, 2, 3, 4]) AS k, unnest([CAST(count(*) FILTER (f1) AS DOUBLE), count(*) FILTER (f2), count(*) FILTER (f3), count(*) FILTER (f4)]) AS x FROM f WHERE source IS NOT NULL GROUP BY source),
p AS (SELECT k, avg(x / n) AS mu, CASE WHEN var_pop(x / n) > 0 THEN greatest(2, least(1000, avg(x / n) * (1 - avg(x / n)) / var_pop(x / n) - 1)) ELSE 1000 END AS wt FROM h GROUP BY k),
b AS (SELECT DISTINCT source FROM h JOIN p USING (k) WHERE (x + mu * wt) / (n + wt) > 0.9)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, f1 OR f2 AS base_failed, b.source IS NOT NULL AS host_rejected, NOT (f1 OR f2) AND b.source IS NULL AS kept
FROM f LEFT JOIN b ON f.source = b.source
"""
