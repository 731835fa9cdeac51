"""Quality classifier by hierarchical empirical Bayes (operator 2).

1. Document evidence: a logistic model over style ratios of the whole text, fitted on a bounded sample of labelled
   documents (``most_labels`` rows, chosen by a hash of doc_id);
2. sites: the share of likely good documents is summed per host (the source up to its first slash) and per path (host
   and language, or the next part of the source). A path's share is shrunk toward its host's, the host's toward the
   global share, by strengths fitted to the spread between groups (method of moments, less sampling variance), so sparse sites follow
   the prior;
3. the score adds the site's log-odds against the global ones to the document's own log-odds.
Sums are partial before their exchange, and a hot source costs one row a task.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from routelens.llm.common import bounded_batches, chunks, materialize, text_bytes
from routelens.llm.shingles import word_hashes

FEATURES = ("log_bytes", "upper", "letter", "digit", "symbol", "stop", "space", "line", "word_bytes", "repeats", "distinct", "symbol_words", "bang")
_UPPER, _LETTER, _DIGIT, _STOP, _BLANK, _LINE, _SYMBOL = range(7)
_CLASS = np.full(256, _SYMBOL, np.int64)
for _c in range(256):
    if 65 <= _c < 91:
        _CLASS[_c] = _UPPER
    elif 97 <= _c < 123 or _c >= 128:
        _CLASS[_c] = _LETTER
    elif 48 <= _c < 58:
        _CLASS[_c] = _DIGIT
    elif chr(_c) in ".,;:'\"-?()":
        _CLASS[_c] = _STOP
    elif chr(_c) in "\n\r":
        _CLASS[_c] = _LINE
    elif _c <= 32:
        _CLASS[_c] = _BLANK
_BAD = np.zeros(256, bool)
_BAD[[ord(c) for c in "!#$%&*|=@^~<>{}[]\\_`"]] = True


def style(data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """Style ratios (rows x FEATURES) of the whole texts; zeros for an empty one."""
    out = np.zeros((len(offsets) - 1, len(FEATURES)))
    for i, j in chunks(offsets):
        raw, at = data[offsets[i] : offsets[j]], offsets[i : j + 1] - offsets[i]
        n, size = j - i, np.maximum(np.diff(at), 1)
        row = np.repeat(np.arange(n), np.diff(at))
        count = np.bincount(row * 7 + _CLASS[raw], minlength=7 * n).reshape(n, 7)
        h, of = word_hashes(data, offsets[i : j + 1])
        words = np.bincount(of, minlength=n)
        w = np.maximum(words, 1)
        again = np.zeros(n)
        if len(h) > 1:
            again = np.bincount(of[1:][(h[1:] == h[:-1]) & (of[1:] == of[:-1])], minlength=n)
        order = np.lexsort((h, of))
        new = np.ones(len(h), bool)
        if len(h) > 1:
            new[1:] = (h[order][1:] != h[order][:-1]) | (of[order][1:] != of[order][:-1])
        distinct = np.bincount(of[order][new], minlength=n)
        bad = np.bincount(row, weights=_BAD[raw], minlength=n)
        f = [np.log1p(np.diff(at)), count[:, _UPPER] / size, count[:, _LETTER] / size, count[:, _DIGIT] / size, count[:, _SYMBOL] / size, count[:, _STOP] / size, count[:, _BLANK] / size]
        f += [count[:, _LINE] / size, size / w, again / w, distinct / w**0.8, np.minimum(bad / w, 3), np.log1p(bad)]
        out[i:j] = np.stack(f, 1) * (np.diff(at) > 0)[:, None]
    return out


def fit_logistic(x: np.ndarray, y: np.ndarray, penalty: float = 1e-3, rounds: int = 40) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(mean, spread, weights with the intercept last) by damped Newton steps on standardised features and their squares."""
    mean, spread = x.mean(0), x.std(0) + 1e-9
    z = expand(x, mean, spread)
    w = np.zeros(z.shape[1])
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-np.clip(z @ w, -30, 30)))
        gradient = z.T @ (p - y) / len(y) + penalty * w
        hessian = (z * (p * (1 - p))[:, None]).T @ z / len(y) + (penalty + 1e-9) * np.eye(len(w))
        step = np.linalg.solve(hessian, gradient)
        w -= step * min(1.0, 4 / (np.abs(step).max() + 1e-12))
        if np.abs(step).max() < 1e-6:
            break
    return mean, spread, w


def expand(x: np.ndarray, mean: np.ndarray, spread: np.ndarray) -> np.ndarray:
    z = np.clip((x - mean) / spread, -8, 8)
    return np.concatenate([z, z * z, np.ones((len(z), 1))], 1)


def _shrunk(good: Column, n: Column, prior: Column, strength: float) -> Column:
    return (good + strength * prior) / (n + strength)


def _strength(groups: DataFrame, prior: str, within: int, low: float = 0.5, high: float = 1000.0) -> float:
    """Beta prior strength from how far groups' true shares lie apart (one-way random effects); within bounds.

    groups: n scores with their sum (good) and sum of squares (squares), and the prior's share; within: number of priors
    fitted, each of which takes a degree of freedom. In units of prior * (1 - prior), squared deviations of the groups' means
    weighted by n are expected to sum to (k - within) * w + rho * (N - sum(n**2) / N), where w is the variance of scores within
    groups, measured beside, and rho = 1 / (strength + 1) that of the true shares. Scores may be counts of 0 and 1 or
    probabilities: what they spread within a group is taken off either way.
    """
    p = F.least(F.greatest(F.col(prior), F.lit(1e-6)), F.lit(1 - 1e-6))
    unit = p * (1 - p)
    between = F.col("n") * F.pow(F.col("good") / F.col("n") - p, 2) / unit
    inside = (F.col("squares") - F.col("good") * F.col("good") / F.col("n")) / unit
    r = groups.agg(F.count("*").alias("k"), F.sum(between).alias("between"), F.sum(inside).alias("inside"), F.sum("n").alias("n"), F.sum(F.col("n").cast("double") * F.col("n")).alias("nn")).first()
    free = r["k"] - within
    if free < 1 or r["n"] == r["k"]:
        return high
    rho = (r["between"] - free * max(0.0, r["inside"]) / (r["n"] - r["k"])) / max(r["n"] - r["nn"] / r["n"], 1e-9)
    return high if rho <= 1 / (high + 1) else float(max(low, 1 / min(rho, 1.0) - 1))


def row_key() -> tuple[Column, Column]:
    """h1 and h2: two hashes of all that a verdict depends on besides the table, nulls apart from empty texts."""
    parts = [F.col(c).isNull() for c in ("text", "source", "lang")] + [F.col(c) for c in ("text", "source", "lang")]
    return F.xxhash64(*parts).alias("h1"), F.xxhash64(F.lit("second"), *parts).alias("h2")


def classify(docs: DataFrame, labels: DataFrame, threshold: float = 0.5, most_labels: int = 20_000, site_weight: float = 0.5, most_sites: int = 100_000, with_key: bool = False) -> DataFrame:
    """Per document: doc_id, evidence, site_share, score (0 to 1), keep (score >= threshold), with ``with_key`` h1 and h2.

    ``docs`` needs doc_id, text, source and lang; ``labels`` doc_id and quality (1 good, 0 bad); other columns are ignored.
    Null labels and labels of unknown documents are ignored; without both classes the evidence is neutral and all are
    kept. A null or empty text has neutral evidence. A null source or language is a site of its own. Repeated rows each
    get a row; repeated labels count once, the least one. A score that ties with the threshold is kept. Very long texts are
    measured whole. Other columns may have any names. An empty table gives an empty result.
    Site shares are broadcast up to ``most_sites`` rows and joined by exchange beyond. h1 and h2 are ``row_key`` of the row.
    """
    spark = docs.sparkSession
    bounded_batches(spark)
    known = labels.where("quality is not null and doc_id is not null").groupBy(F.col("doc_id").cast("long").alias("doc_id")).agg(F.min("quality").alias("quality"))
    chosen = known.orderBy(F.xxhash64("doc_id"), "doc_id").limit(most_labels)
    host = F.element_at(F.split(F.coalesce("source", F.lit("")), "/"), 1)
    path = F.concat_ws("/", F.coalesce("source", F.lit("")), F.coalesce("lang", F.lit("")))
    base = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text", host.alias("host"), path.alias("path"), *(row_key() if with_key else ()))
    more = ["h1", "h2"] if with_key else []
    kinds = "".join(f", {x} long" for x in more)
    width = len(FEATURES)

    def measure(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            f = style(*text_bytes(b.column(1)))
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(2), b.column(3), pa.array(list(f), pa.list_(pa.float64())), *b.columns[4:]], ["doc_id", "host", "path", "f", *more])

    measured = materialize(base.mapInArrow(measure, "doc_id long, host string, path string, f array<double>" + kinds), "style")
    sample = measured.join(F.broadcast(chosen), "doc_id")
    sample = sample.orderBy(F.xxhash64("doc_id"), "doc_id", "f").limit(most_labels).select("f", "quality").toArrow()
    y = sample["quality"].to_numpy().astype(float)
    x = np.array(sample["f"].combine_chunks().flatten(), float).reshape(-1, width)
    if len(y) and 0 < y.sum() < len(y):
        mean, spread, weights = fit_logistic(x, y)
    else:
        mean, spread, weights = np.zeros(width), np.ones(width), np.zeros(2 * width + 1)

    def judge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            f = np.array(b.column(3).flatten(), float).reshape(-1, width)
            logit = np.clip(expand(f, mean, spread) @ weights, -30, 30)
            logit[~f.any(1)] = 0
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), b.column(2), pa.array(logit), *b.columns[4:]], ["doc_id", "host", "path", "evidence", *more])

    judged = measured.mapInArrow(judge, "doc_id long, host string, path string, evidence double" + kinds)
    own = 1 / (1 + F.exp(-F.col("evidence")))
    total = lambda rows, *keys: rows.groupBy(*keys).agg(*(F.sum(c).alias(c) for c in ("good", "squares", "n")))
    paths = materialize(total(judged.select("host", "path", own.alias("good"), (own * own).alias("squares"), F.lit(1).alias("n")), "host", "path"), "paths")
    hosts = total(paths, "host")
    whole = paths.agg(F.sum("good").alias("good"), F.sum("n").alias("n")).first()
    share = (whole["good"] or 0.0) / whole["n"] if whole["n"] else 0.5
    share = min(1 - 1e-6, max(1e-6, share))
    hosts = materialize(hosts.withColumn("prior", F.lit(share)), "hosts")
    of_hosts = _strength(hosts, "prior", 1)
    hosts = hosts.select("host", F.col("good").alias("host_good"), F.col("n").alias("host_n"), _shrunk(F.col("good"), F.col("n"), F.lit(share), of_hosts).alias("host_share"))
    paths = paths.join(hosts, "host")
    of_paths = _strength(paths, "host_share", hosts.count())
    sites = materialize(paths.select("host", "path", "good", "n", "host_good", "host_n"), "sites")
    if sites.count() <= most_sites:
        sites = F.broadcast(sites)
    judged = judged.join(sites, ["host", "path"])
    # a document's own evidence counts once: its site and host are judged by the others
    host_share = _shrunk(F.col("host_good") - own, F.col("host_n") - 1, F.lit(share), of_hosts)
    site_share = _shrunk(F.col("good") - own, F.col("n") - 1, host_share, of_paths)
    judged = judged.withColumn("site_share", site_share)
    held = F.least(F.greatest("site_share", F.lit(1e-6)), F.lit(1 - 1e-6))
    logit = F.col("evidence") + site_weight * (F.log(held / (1 - held)) - float(np.log(share / (1 - share))))
    out = judged.withColumn("score", 1 / (1 + F.exp(-logit)))
    return out.select("doc_id", "evidence", "site_share", "score", (F.col("score") >= threshold).alias("keep"), *more)
