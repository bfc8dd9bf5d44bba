"""Quality rules on documents and on their hosts.

Each document is measured and held against simple rules. Failures are summed by host; a host's failure rate is the mean
of its beta posterior, under a beta prior fitted to all hosts by moments, so small hosts lean on the rest. The verdict on
the host goes back to its documents: on a host whose rate reaches `suspect`, one failed rule is enough to reject a
document; on others, two are. A document that fails no rule is kept wherever it comes from.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from geoweave.llm import text as tx
from geoweave.shared import written

_SYMBOL = np.zeros(256, bool)
_SYMBOL[list(b"#*$%&|<>")] = True
_LEAD = np.ones(256, bool)
_LEAD[0x80:0xC0] = False  # bytes after a character's first
_LETTER = np.zeros(256, bool)
_LETTER[65:91] = _LETTER[97:123] = True
_LETTER[0x80:] = True
_UPPER = np.zeros(256, bool)
_UPPER[65:91] = True
_MARK = np.zeros(256, bool)
_MARK[list(b"!?")] = True

MEASURES = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_lines", "n_marks", "n_upper", "n_distinct"]


def measures(data: np.ndarray, offsets: np.ndarray, window: int = 5) -> dict[str, np.ndarray]:
    """What is counted in each text; n_repeat_words: words in windows that the text has twice or more, the first included."""
    words = tx.Words(data, offsets)
    n_words = np.diff(words.first)

    def within(mask: np.ndarray) -> np.ndarray:
        return tx.per_text(mask, offsets)

    # lines end at \n and at the text's end; a line with a word counts
    begins = np.union1d(offsets[:-1], np.flatnonzero(data == 10) + 1)
    begins = begins[begins <= len(data)]
    ends = np.append(begins[1:], len(data)).astype(np.int64)
    newline = np.zeros(len(begins), np.int64)
    newline[:-1] = data[ends[:-1] - 1] == 10
    if len(data) and len(begins):
        newline[-1] = data[-1] == 10
    stop = np.maximum(ends - newline, begins)
    has_word = np.searchsorted(words.start, stop) > np.searchsorted(words.start, begins)
    begins, stop = begins[has_word], stop[has_word]
    line = tx.byte_spans(words.prefix, begins, stop)
    owner = np.searchsorted(offsets, begins, "right") - 1
    order = np.lexsort((line, owner))
    again = np.zeros(len(line), bool)
    again[1:] = (line[order][1:] == line[order][:-1]) & (owner[order][1:] == owner[order][:-1])
    rows = len(offsets) - 1

    grams, start = words.grams(window)
    doc = words.doc[start]
    sort = np.lexsort((grams, doc))
    same = (grams[sort][1:] == grams[sort][:-1]) & (doc[sort][1:] == doc[sort][:-1]) if len(sort) else np.zeros(0, bool)
    twice = np.zeros(len(sort), bool)
    twice[1:] |= same
    twice[:-1] |= same
    edge = np.zeros(len(words) + 1, np.int64)
    at = start[sort[twice]]
    np.add.at(edge, at, 1)
    np.add.at(edge, at + window, -1)
    distinct = np.lexsort((words.hash, words.doc))
    fresh = np.ones(len(words), bool)
    fresh[1:] = (words.hash[distinct][1:] != words.hash[distinct][:-1]) | (words.doc[distinct][1:] != words.doc[distinct][:-1])
    return {
        "n_words": n_words,
        "word_chars": within(_LEAD[data] & ~tx._SPACE[data]),
        "n_symbols": within(_SYMBOL[data]),
        "n_dup_lines": np.bincount(owner[order][again], minlength=rows),
        "n_repeat_words": tx.per_text(np.cumsum(edge)[:-1] > 0, words.first),
        "n_lines": np.bincount(owner, minlength=rows),
        "n_marks": within(_MARK[data]),
        "n_upper": within(_UPPER[data]),
        "n_distinct": np.bincount(words.doc[distinct][fresh], minlength=rows),
    }


def measured(docs: DataFrame) -> DataFrame:
    """docs (doc_id, host, text) as (doc_id, host, and MEASURES)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for a, b, data, offsets in tx.slices(batch.column(2)):
                found = measures(data, offsets)
                yield pa.RecordBatch.from_arrays([batch.column(i).slice(a, b - a) for i in (0, 1)] + [pa.array(found[m].astype(np.int64)) for m in MEASURES], names=["doc_id", "host", *MEASURES])

    return docs.mapInArrow(run, "doc_id long, host string, " + ", ".join(f"{m} long" for m in MEASURES))


def with_measures(docs: DataFrame) -> DataFrame:
    """docs (host, text, rest) with MEASURES."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for a, b, data, offsets in tx.slices(batch.column(1)):
                found = measures(data, offsets)
                yield pa.RecordBatch.from_arrays([c.slice(a, b - a) for c in batch.columns] + [pa.array(found[m].astype(np.int64)) for m in MEASURES], names=["host", "text", "rest", *MEASURES])

    kind = docs.schema["rest"].dataType.simpleString()
    return docs.mapInArrow(run, f"host string, text string, rest {kind}, " + ", ".join(f"{m} long" for m in MEASURES))


def base_failed() -> Column:
    return (F.col("n_words") < 10) | (100 * F.col("n_repeat_words") > 20 * F.col("n_words"))


def rules(times: int = 1) -> dict[str, Column]:
    """Rules beside the base: true is a failure. With a larger number a part of the limits is enough."""
    n, chars = F.col("n_words"), F.col("word_chars")
    return {
        "symbols": F.col("n_symbols") * 10 * times > n,
        "dup_lines": F.col("n_dup_lines") * 10 * times > F.col("n_lines") * 3,
        "word_length": (chars < 3 * n) | (chars > 12 * n),
        "marks": F.col("n_marks") * 10 * times > n * 3,
        "capitals": F.col("n_upper") * 10 * times > chars * 3,
    }


#: What a host's shrunk rate of failures makes of it.
TRUSTED, ORDINARY, SUSPECT = -1, 0, 1


def host_verdicts(failures: DataFrame, spreads: float = 1.0) -> DataFrame:
    """(host, host_docs, host_failures, host_rate, host_verdict) for failures (host, failed): rates shrunk by the beta prior of all hosts.

    The prior has the hosts' mean rate and, by moments, their variance beyond that of counting; hosts that differ no more
    than chance lean on it wholly. A host is suspect if its shrunk rate lies more than `spreads` standard deviations of the
    prior above the prior's mean, trusted if as much below, else ordinary: where hosts are alike all are ordinary.
    """
    hosts = failures.groupBy("host").agg(F.count("*").alias("host_docs"), F.sum(F.col("failed").cast("long")).alias("host_failures"))
    rate = F.col("host_failures") / F.col("host_docs")
    over = hosts.agg(
        F.coalesce(F.sum("host_failures") / F.sum("host_docs"), F.lit(0.0)).alias("mean"),
        F.coalesce(F.var_samp(rate), F.lit(0.0)).alias("var"),
        F.coalesce(F.avg(1 / F.col("host_docs")), F.lit(1.0)).alias("inverse"),
    )
    mean, spread = F.col("mean"), F.col("mean") * (1 - F.col("mean"))
    between = F.greatest(F.col("var") - spread * F.col("inverse"), spread * 1e-4, F.lit(1e-12))
    strength = F.greatest(spread / between - 1, F.lit(1.0)).alias("strength")
    prior = over.select("mean", strength, F.sqrt(between).alias("sd"))
    posterior = (F.col("host_failures") + mean * F.col("strength")) / (F.col("host_docs") + F.col("strength"))
    off = posterior - mean
    found = F.when(off > spreads * F.col("sd"), SUSPECT).when(off < -spreads * F.col("sd"), TRUSTED).otherwise(ORDINARY)
    # the prior is one row
    return hosts.join(F.broadcast(prior)).select("host", "host_docs", "host_failures", posterior.alias("host_rate"), found.alias("host_verdict"))


def failed_rules(times: int = 1) -> Column:
    return sum((F.when(r, 1).otherwise(0) for r in rules(times).values()), F.lit(0))


def with_failures(measured: DataFrame) -> DataFrame:
    """measured with base_failed, n_failed, and n_near: rules of which half the limit is passed."""
    return measured.withColumn("base_failed", base_failed()).withColumn("n_failed", failed_rules()).withColumn("n_near", failed_rules(2))


def verdict() -> Column:
    """A failed rule rejects a document, on a trusted host the second does; on a suspect host half a rule's limit is enough."""
    host = F.col("host_verdict")
    allowed = F.when(host == TRUSTED, F.col("n_failed") < 2).when(host == SUSPECT, F.col("n_near") < 1).otherwise(F.col("n_failed") < 1)
    return ~F.col("base_failed") & allowed


def keep_documents(docs: DataFrame, host: str, spreads: float = 1.0) -> DataFrame:
    """The rows of docs (text, and others) that `judge` keeps, with their columns as they are.

    Measures every text twice rather than shuffle the texts: for the hosts' rates, and for the rows' own verdict. Texts are
    measured whole, however long; null ones count as empty.
    """
    others = [F.col(f"`{c}`") for c in docs.columns if c != "text"]
    rows = tx.in_small_batches(docs).select(F.col(f"`{host}`").cast("string").alias("host"), F.col("text").cast("string").alias("text"), F.struct(*others).alias("rest"))
    judged = with_failures(with_measures(rows))
    hosts = written(host_verdicts(judged.select("host", (F.col("base_failed") | (F.col("n_failed") > 0)).alias("failed")), spreads), "hosts")
    hosts = hosts.select(F.col("host").alias("of"), "host_verdict")
    kept = judged.join(hosts, F.col("host").eqNullSafe(F.col("of"))).where(verdict())
    return kept.select(*[F.col("text") if c == "text" else F.col(f"rest.`{c}`") for c in docs.columns])


def judge(docs: DataFrame, spreads: float = 1.0) -> DataFrame:
    """docs (doc_id, host, text) as (doc_id, host, MEASURES, base_failed, n_failed, n_near, host_rate, host_verdict, kept).

    Texts are measured whole, however long. Null texts count as empty and fail the base rule of at least ten words. Rows with a
    null host are one host of their own. Rows that share an id are judged each for itself. Ties at a threshold pass. Empty
    tables give empty ones.
    """
    docs = tx.in_small_batches(docs).select(F.col("doc_id").cast("long").alias("doc_id"), F.col("host").cast("string").alias("host"), F.col("text").cast("string").alias("text"))
    seen = with_failures(written(measured(docs), "measures"))
    hosts = host_verdicts(seen.select("host", (F.col("base_failed") | (F.col("n_failed") > 0)).alias("failed")), spreads)
    hosts = hosts.select(F.col("host").alias("of"), "host_rate", "host_verdict")
    return seen.join(hosts, F.col("host").eqNullSafe(F.col("of"))).select(*seen.columns, "host_rate", "host_verdict", verdict().alias("kept"))
