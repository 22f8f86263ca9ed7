"""Quality rules with host verdicts.

Each whole text is measured once and tested by rules; a host's rate of failing documents is shrunk towards that of all
hosts by a beta prior whose two parameters come from the hosts themselves (method of moments), so a host with few
documents is judged mostly by the prior. A host is rejected if its shrunk rate is too high, and its verdict goes back
to its documents. A document is kept if it fails no rule and its host stands.

Words are runs outside \\x20 and \\x09-\\x0D. NULL or empty texts have no words and fail; a NULL host is a host of its
own. Rows that repeat a doc_id, or have none, are judged each. An empty table gives none.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

from tessera.llm.shared import documents, map_arrow, save, slices
from tessera.llm.words import SPACE, Words, mix, words

WINDOW = 5
#: A host is rejected if its shrunk rate of failing documents is above this.
HOST_LIMIT = 0.5
#: Hosts up to this number are sent to every task; more are joined by key.
BROADCAST_HOSTS = 100_000
SYMBOL = np.zeros(256, bool)
SYMBOL[list(b"#*$%&|<>")] = True
LEADS = (np.arange(256) & 0xC0) != 0x80
BLANKS = b" \t\n\x0b\x0c\r"
MEASURES = "n_words bigint, word_chars bigint, n_symbols bigint, n_dup_lines bigint, n_repeat_words bigint, n_lines bigint"


def repeated_words(w: Words, k: int = WINDOW) -> np.ndarray:
    """For each text the words inside windows of k words that its text holds twice or more."""
    hashes, inside = w.windows(k)
    at = np.flatnonzero(inside)
    doc = np.repeat(np.arange(len(w)), np.diff(w.first))
    keys = mix(hashes[at] ^ mix(doc[at].astype(np.uint64) + np.uint64(1)))
    ordered = np.sort(keys)
    twice = np.unique(ordered[1:][ordered[1:] == ordered[:-1]])
    if not len(twice):
        return np.zeros(len(w), np.int64)
    place = np.minimum(np.searchsorted(twice, keys), len(twice) - 1)
    marks = np.zeros(len(w.hashes) + 1, np.int64)
    hit = at[twice[place] == keys]
    np.add.at(marks, hit, 1)
    np.add.at(marks, hit + k, -1)
    covered = np.concatenate([[0], np.cumsum(np.cumsum(marks[:-1]) > 0)])
    return covered[w.first[1:]] - covered[w.first[:-1]]


def sums(flags: np.ndarray, at: np.ndarray) -> np.ndarray:
    total = np.concatenate([[0], np.cumsum(flags, dtype=np.int64)])
    return total[at[1:]] - total[at[:-1]]


def measure(texts: pa.Array) -> dict:
    """The columns of MEASURES for a batch of texts."""
    w = words(texts)
    lines, dups = [], []
    for a, b in zip(w.at[:-1].tolist(), w.at[1:].tolist(), strict=True):
        own = [x for x in w.data[a:b].tobytes().split(b"\n") if x.strip(BLANKS)]
        lines.append(len(own))
        dups.append(len(own) - len(set(own)))
    return {
        "n_words": np.diff(w.first), "word_chars": sums(LEADS[w.data] & ~SPACE[w.data], w.at), "n_symbols": sums(SYMBOL[w.data], w.at),
        "n_dup_lines": dups, "n_repeat_words": repeated_words(w), "n_lines": lines,
    }


def measured(docs: DataFrame, host: str = "source") -> DataFrame:
    """doc_id, host and the measures of each whole text."""

    def run(part: pa.RecordBatch) -> dict:
        return {"doc_id": part.column("doc_id"), "host": part.column("host")} | measure(part.column("text"))

    return map_arrow(documents(docs, F.col(host).cast("string").alias("host")), run, f"doc_id bigint, host string, {MEASURES}")


def base_failed() -> Column:
    """Too few words, or too many of them in repeated windows."""
    return (F.col("n_words") < 10) | (100 * F.col("n_repeat_words") > 20 * F.col("n_words"))


def rule_failed() -> Column:
    """The base rules, or: symbols over a tenth of the words; 30 % of the lines repeat earlier ones; words of under 3 or over 10 characters on average."""
    n, chars = F.col("n_words"), F.col("word_chars")
    return base_failed() | (10 * F.col("n_symbols") > n) | (10 * F.col("n_dup_lines") > 3 * F.col("n_lines")) | (chars < 3 * n) | (chars > 10 * n)


def host_rates(judged: DataFrame) -> DataFrame:
    """host, n, failed, rate: failures of each host, shrunk by the beta prior fitted to all hosts. judged: host, failed (boolean)."""
    hosts = save(judged.groupBy("host").agg(F.count(F.lit(1)).alias("n"), F.sum(F.col("failed").cast("bigint")).alias("failed")), "hosts")
    p = hosts.agg((F.sum("failed") / F.sum("n")).alias("p"), F.sum("n").alias("total"), F.count(F.lit(1)).alias("hosts"))
    spread = hosts.crossJoin(F.broadcast(p)).agg(  # p is one row
        F.first("p").alias("p"), F.first("total").alias("total"), F.first("hosts").alias("hosts"),
        F.sum(F.col("n") * F.pow(F.col("failed") / F.col("n") - F.col("p"), 2)).alias("s"), F.sum(F.col("n").cast("double") * F.col("n")).alias("nn"),
    )
    row = spread.first()
    if row is None or not row.total:
        return hosts.withColumn("rate", F.lit(0.0))
    variance, within = row.p * (1 - row.p), row.hosts - 1
    room = row.total - row.nn / row.total - within
    share = (row.s - variance * within) / (variance * room) if variance * room > 0 else 0.0
    share = min(max(share, 1e-6), 0.99)  # intra-host correlation
    strength = 1 / share - 1  # alpha + beta
    return hosts.withColumn("rate", (F.col("failed") + row.p * strength) / (F.col("n") + strength))


def with_hosts(rows: DataFrame, rates: DataFrame) -> DataFrame:
    """rows (with host) and their host's rate; few hosts are broadcast, many are joined by key."""
    known = rates.select(F.col("host").alias("__host"), "rate")
    if rates.count() <= BROADCAST_HOSTS:
        known = F.broadcast(known)
    return rows.join(known, F.col("host").eqNullSafe(F.col("__host")), "left").drop("__host")


def judge(docs: DataFrame, host: str = "source") -> DataFrame:
    """doc_id, the measures, base_failed, kept, and the host's shrunk rate, for each document."""
    rows = save(measured(docs, host), "measured")
    rates = host_rates(rows.select("host", rule_failed().alias("failed")))
    out = with_hosts(rows, rates)
    kept = ~rule_failed() & (F.col("rate") <= HOST_LIMIT)
    return out.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", base_failed().alias("base_failed"), kept.alias("kept"), F.round("rate", 6).alias("host_rate"))


def keep_good(docs: DataFrame, host: str = "source") -> DataFrame:
    """The rows that are kept, with their own columns, whatever their names. Texts are measured again rather than moved."""
    from pyspark.sql.pandas.types import to_arrow_schema
    from pyspark.sql.types import StructField, StructType

    rates = host_rates(measured(docs, host).select("host", rule_failed().alias("failed")))
    names = [f.name for f in StructType.fromDDL(MEASURES).fields]
    schema = StructType([StructField("row", docs.schema), StructField("host", StringType()), *StructType.fromDDL(MEASURES).fields])
    arrow, place = to_arrow_schema(schema), docs.columns.index("text")

    def run(batches):
        for batch in batches:
            whole = pa.RecordBatch.from_arrays([batch.column("row"), batch.column("host"), batch.column("row").flatten()[place]], names=["row", "host", "text"])
            for part in slices(whole):
                m = measure(part.column("text"))
                columns = [part.column("row"), part.column("host"), *[pa.array(m[c], pa.int64()) for c in names]]
                yield pa.RecordBatch.from_arrays([c.cast(f.type) for c, f in zip(columns, arrow, strict=True)], schema=arrow)

    # the rows travel as one column, so that no name of theirs can clash
    rows = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"), F.col(f"`{host}`").cast("string").alias("host"))
    rows = with_hosts(rows.mapInArrow(run, schema).where(~rule_failed()), rates)
    return rows.where(F.col("rate") <= HOST_LIMIT).select("row.*")
