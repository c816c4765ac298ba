"""Host-level quality rules.

Each document is measured (:func:`measures`) and held against the ``RULES``. Failures are counted per host and rule; a host's
failure rate of a rule is shrunk towards all hosts' by a beta prior fitted to the hosts' counts (moments of the beta-binomial),
so a host with few documents says little. The limit of a rule lies between the prior's mean and one, so it follows what is
usual in the given data. A host whose rate of any rule is above the limit even at the lower end of its
posterior interval is rejected with all its documents. Hosts that differ by chance only are never rejected.

Null and empty texts have no words and fail. A null host is a host of its own. Repeated rows count as often as they
occur. Columns other than doc_id, text and the host's are left out. An empty table gives an empty table. Counts are
summed before they are shuffled, and verdicts are joined to the measures, not to the texts.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from eventlink.llm.common import IS_WORD, U64, Words, chunks, mixed, texts, written

SYMBOLS = b"#*$%&|<>"
_IS_SYMBOL = np.zeros(256, bool)
_IS_SYMBOL[list(SYMBOLS)] = True
COUNTS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")
MEASURES = (*COUNTS, "n_lines")
#: A document's rules. The first two make up the base rule.
RULES = {
    "short": "n_words < 50",
    "repeats": "100 * n_repeat_words > 50 * n_words",
    "symbols": "10 * n_symbols > n_words",
    "lines": "100 * n_dup_lines > 30 * n_lines",
}
FAILED = f"({RULES['short']} OR {RULES['repeats']})"


@dataclass(frozen=True)
class Verdict:
    """A host is rejected if, for any rule, its posterior mean failure rate less ``deviations`` standard deviations is above the limit.

    The limit lies ``rise`` of the way from the prior's mean to one.
    """

    rise: float = 0.3
    deviations: float = 2.0


def measures(docs: DataFrame, host: str = "source") -> DataFrame:
    """doc_id, host and the counts of each text."""

    def measure(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, raw, at in chunks(batches):
            found = count(raw, at)
            columns = [batch.column(0), batch.column(2), *(pa.array(x, pa.int64()) for x in found)]
            yield pa.RecordBatch.from_arrays(columns, names=["doc_id", "host", *MEASURES])

    schema = "doc_id long, host string, " + ", ".join(f"{c} long" for c in MEASURES)
    return texts(docs, F.col(host).cast("string").alias("host")).mapInArrow(measure, schema)


def count(raw: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, ...]:
    """The counts of ``MEASURES`` for each text of a chunk."""

    def per_text(flags: np.ndarray) -> np.ndarray:
        return np.diff(np.concatenate([[0], np.cumsum(flags)])[at])

    words = Words(raw, at)
    repeated = np.zeros(len(words.start), bool)
    inside = words.inside(3)
    if inside.any():
        h = words.hash
        n = len(inside)
        grams = mixed(mixed(mixed(h[:n]) + h[1 : n + 1]) + h[2:]) + mixed(words.doc[:n].astype(U64))
        places = np.flatnonzero(inside)
        order = places[np.argsort(grams[places], kind="stable")]
        same = grams[order][1:] == grams[order][:-1]
        twice = np.zeros(len(order), bool)
        twice[1:] |= same
        twice[:-1] |= same
        for k in range(3):
            repeated[order[twice] + k] = True
    repeats = np.diff(np.concatenate([[0], np.cumsum(repeated)])[words.first])
    data = raw.tobytes()
    lines, whole = np.zeros(len(at) - 1, np.int64), np.zeros(len(at) - 1, np.int64)
    for k in range(len(lines)):
        said = [line for line in data[at[k] : at[k + 1]].split(b"\n") if line.strip()]
        lines[k], whole[k] = len(said) - len(set(said)), len(said)
    return words.count, per_text(IS_WORD[raw] & (raw & 0xC0 != 0x80)), per_text(_IS_SYMBOL[raw]), lines, repeats, whole


def host_verdicts(measured: DataFrame, verdict: Verdict = Verdict()) -> DataFrame:
    """Per host: documents, and for each rule its failures, the shrunk rate and the rate's lower end; and the rules it is rejected by."""
    failures = [F.sum(F.expr(rule).cast("long")).alias(f"failed_{name}") for name, rule in RULES.items()]
    hosts = written(measured.groupBy("host").agg(F.count("*").alias("n_docs"), *failures))
    n = F.col("n_docs").cast("double")
    sums = [F.count("*").alias("hosts"), F.sum(n).alias("n"), F.sum(n * n).alias("nn")]
    for name in RULES:
        f = F.col(f"failed_{name}").cast("double")
        sums += [F.sum(f).alias(f"f_{name}"), F.sum(f * f / n).alias(f"ff_{name}")]
    total = {k: float(v or 0) for k, v in hosts.agg(*sums).first().asDict().items()}
    columns, rejected = [], []
    for name in RULES:
        alpha, beta = beta_prior(total["hosts"], total["n"], total[f"f_{name}"], total["nn"], total[f"ff_{name}"])
        a, b = F.col(f"failed_{name}") + alpha, n - F.col(f"failed_{name}") + beta
        rate, mean = a / (a + b), alpha / (alpha + beta)
        lower = rate - verdict.deviations * F.sqrt(a * b / ((a + b) * (a + b) * (a + b + 1)))
        columns += [f"failed_{name}", rate.alias(f"rate_{name}"), lower.alias(f"lower_{name}")]
        rejected.append(F.when(lower > mean + verdict.rise * (1 - mean), name))
    return hosts.select("host", "n_docs", *columns, F.array_compact(F.array(*rejected)).alias("rejected_by"))


def beta_prior(hosts: float, n: float, f: float, nn: float, ff: float) -> tuple[float, float]:
    """Alpha and beta from sums over hosts: documents n, failures f, n squared, and f squared over n.

    Hosts that differ no more than chance lets them get a strong prior; without any failure or any pass, or with one
    host, the prior is that of one pass and one failure.
    """
    if hosts < 2 or f <= 0 or f >= n:
        return 1.0, 1.0
    mean = f / n
    spread = ff - n * mean * mean
    chance = mean * (1 - mean)
    between = n - nn / n - (hosts - 1)
    share = (spread - chance * (hosts - 1)) / (chance * between) if between > 0 else 1.0
    share = min(max(share, 1e-4), 0.5)
    strength = 1 / share - 1
    return mean * strength, (1 - mean) * strength


def judge(docs: DataFrame, host: str = "source", verdict: Verdict = Verdict()) -> DataFrame:
    """doc_id, host, the counts, base_failed, the rules that reject the host, and kept.

    The measures are written once, as two steps read them.
    """
    measured = written(measures(docs, host))
    verdicts = host_verdicts(measured, verdict).select(F.col("host").alias("_host"), "rejected_by")
    joined = measured.join(verdicts, F.col("host").eqNullSafe(F.col("_host")), "left")
    return joined.select(
        "doc_id",
        "host",
        *MEASURES,
        F.expr(FAILED).alias("base_failed"),
        F.col("rejected_by").alias("host_rejected_by"),
        (~F.expr(FAILED) & (F.size("rejected_by") == 0)).alias("kept"),
    )


def _sql() -> str:
    """Rows of the query, with the table's own hosts judged by the same rules."""
    rules = ", ".join(f"({rule}) AS {name}" for name, rule in RULES.items())
    long = " UNION ALL ".join(f"SELECT source, '{name}' AS rule, count(*)::DOUBLE AS n, count(*) FILTER ({name})::DOUBLE AS f FROM judged GROUP BY source" for name in RULES)
    return rf"""
WITH words AS (
    SELECT doc_id, source, coalesce(text, '') AS text,
        regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w
    FROM documents
), grams AS (
    SELECT doc_id, k, list_aggregate(list_slice(w, k, k + 2), 'string_agg', ' ') AS g
    FROM (SELECT doc_id, w, unnest(range(1, len(w) - 1)) AS k FROM words)
), twice AS (
    SELECT doc_id, k FROM grams QUALIFY count(*) OVER (PARTITION BY doc_id, g) > 1
), repeats AS (
    SELECT doc_id, count(DISTINCT k + j) AS n FROM twice, (SELECT unnest([0, 1, 2]) AS j) GROUP BY doc_id
), lines AS (
    SELECT doc_id, count(*) AS n_lines, count(*) - count(DISTINCT line) AS n
    FROM (SELECT doc_id, unnest(string_split(text, chr(10))) AS line FROM words)
    WHERE regexp_matches(line, '[^\x20\x09-\x0D]') GROUP BY doc_id
), measured AS (
    SELECT words.doc_id, source, len(w) AS n_words, length(regexp_replace(text, '[\x20\x09-\x0D]', '', 'g')) AS word_chars,
        length(regexp_replace(text, '[^#*$%&|<>]', '', 'g')) AS n_symbols, coalesce(lines.n, 0) AS n_dup_lines,
        coalesce(repeats.n, 0) AS n_repeat_words, coalesce(lines.n_lines, 0) AS n_lines
    FROM words LEFT JOIN repeats USING (doc_id) LEFT JOIN lines USING (doc_id)
), judged AS (
    SELECT *, {rules} FROM measured
), hosts AS (
    {long}
), sums AS (
    SELECT rule, count(*) AS hosts, sum(n) AS n, sum(f) AS f, sum(n * n) AS nn, sum(f * f / n) AS ff, sum(f) / sum(n) AS m
    FROM hosts GROUP BY rule
), share AS (
    SELECT *, hosts < 2 OR f <= 0 OR f >= n AS plain, n - nn / n - (hosts - 1) AS between_hosts FROM sums
), strength AS (
    SELECT *, CASE WHEN plain THEN 2 ELSE 1 / least(greatest(CASE WHEN between_hosts > 0
        THEN (ff - n * m * m - m * (1 - m) * (hosts - 1)) / (m * (1 - m) * between_hosts) ELSE 1 END, 1e-4), 0.5) - 1
        END AS s, CASE WHEN plain THEN 0.5 ELSE m END AS middle
    FROM share
), posterior AS (
    SELECT source, rule, middle, hosts.f + middle * s AS a, hosts.n - hosts.f + (1 - middle) * s AS b
    FROM hosts JOIN strength USING (rule)
), verdicts AS (
    SELECT source, bool_or(a / (a + b) - 2 * sqrt(a * b / ((a + b) * (a + b) * (a + b + 1))) > middle + 0.3 * (1 - middle)) AS rejected
    FROM posterior GROUP BY source
)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, short OR repeats AS base_failed,
    NOT (short OR repeats) AND NOT rejected AS kept
FROM judged LEFT JOIN verdicts ON judged.source IS NOT DISTINCT FROM verdicts.source
"""


SQL = _sql()
