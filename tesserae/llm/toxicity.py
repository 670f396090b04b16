"""Toxicity: a support vector machine on a gapped subsequence kernel of words, with Nystroem landmarks.

Units. A text is split into words; letters are folded (case, accents, digits and signs that stand for letters),
other characters inside a word are dropped, and words of one letter in a row are joined, so `I.d-1 0 t`, `i d i o t`
and `idiot` are one unit.

Kernel. Units are compared by their subsequences of three letters that span at most SPAN letters; each occurrence
weighs DECAY for each letter that it skips (the string kernel of Lodhi et al., 2002, with bounded span), and vectors
are normalised. An inserted or missing letter so costs a part of the similarity, not all of it.

Machine. Instances are the units of labelled sentences, not whole sentences: in a kernel over a sentence one insult
drowns in its other words. As only some words of a toxic text are insults, units that stand in surprisingly many
toxic texts are positive instances; texts are counted by groups of near-copies, so that a copied text counts once.
Kernel values against LANDMARKS units, whitened by their own kernel matrix (Nystroem), feed a linear SVM.
The decision is linear in the explicit subsequence weights, so it folds into one table from which a unit is scored
exactly as by the kernel sums.

A text's score is a logistic function of its three highest unit decisions and of how many units are positive. It is
fitted on labelled texts of one half of the sample with a machine of the other half; the final machine has both.

Fitting uses a bounded sample: at most SAMPLE_TOXIC and SAMPLE_CLEAN labelled texts, by hash of doc_id, equal texts
counted once. Labels are read from the training fold only, and no other column is an input.

Defined cases: a null text is empty; a text without units scores by its absent units, low; rows with a null label
or doc_id are not learnt from; a doc_id with two labels is toxic if one says so; without labels of both classes every
score is 0; repeated rows score alike; an empty table gives no rows; other columns play no part, whatever their
names; a very long text is read in one piece, in memory in proportion to it.
"""

from __future__ import annotations

import unicodedata
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tesserae.llm._store import stored
from tesserae.llm._text import POWERS, U64, chunks, mix

SPAN = 5
DECAY = 0.5
LANDMARKS = 384
SAMPLE_TOXIC, SAMPLE_CLEAN = 2500, 5000
#: Units of each kind that the machine is fitted on.
MOST_POSITIVE, MOST_NEGATIVE = 3000, 8000
#: Groups of toxic texts that an insult stands in at least, and how surprising their number is at least, in nats.
LEAST_GROUPS, SURPRISE = 3, 9.0
#: Cost of a positive unit by its groups, up to so many, and of a negative one; rounds of the solver.
COST, MOST_GROUPS, NEGATIVE_COST, ROUNDS = 5.0, 100, 10.0, 40
THRESHOLD = 0.7
#: Text bytes worked on at once: each letter gives several subsequences of 24 bytes and more.
CHUNK_BYTES = 1 << 18
CLASSES = 64
GAPS = [(i, k) for k in range(2, SPAN) for i in range(1, k)]
# Signs and digits that stand for letters.
STANDS_FOR = {"0": "o", "1": "i", "3": "e", "4": "a", "5": "s", "7": "t", "@": "a", "$": "s"}
ABSENT = -2.0


def _classes() -> np.ndarray:
    """Code point to class: 0 dropped, 1-26 letters, 27-63 letters of other alphabets, 255 separators."""
    table = np.zeros(0x600, np.uint8)
    for code in range(len(table)):
        char = STANDS_FOR.get(chr(code), chr(code))
        folded = unicodedata.normalize("NFKD", char).casefold()[:1]
        if "a" <= folded <= "z":
            table[code] = ord(folded) - 96
        elif char.isalpha():
            table[code] = 27 + code % 37
    table[[0x20, *range(0x09, 0x0E)]] = 255
    return table


CLASS = _classes()


def units(data: np.ndarray, offs: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(classes of all letters, start of each unit among them, document of each unit); units without letters go."""
    lead = (data & 0xC0) != 0x80
    codes = np.frombuffer(data.tobytes().decode("utf-8", "replace").encode("utf-32-le"), np.uint32)
    bounds = np.concatenate([[0], np.cumsum(lead)])[offs]
    kind = CLASS[np.minimum(codes, len(CLASS) - 1)]
    kind = np.where(codes >= len(CLASS), 27 + codes % 37, kind).astype(np.uint8)
    inside = kind != 255
    doc_start = np.zeros(len(codes) + 1, bool)
    doc_start[bounds[:-1]] = True
    first = inside.copy()
    first[1:] &= ~inside[:-1] | doc_start[1:-1]
    start = np.flatnonzero(first)
    if not len(start):
        return np.zeros(0, np.uint8), np.zeros(0, np.int64), np.zeros(0, np.int64)
    doc = np.searchsorted(bounds, start, side="right") - 1
    single = np.add.reduceat((inside & (kind > 0)).astype(np.int64), start) == 1
    joined = np.zeros(len(start), bool)
    joined[1:] = single[1:] & single[:-1] & (doc[1:] == doc[:-1])
    unit_of_word = np.cumsum(~joined) - 1
    doc = doc[~joined]
    letters = np.flatnonzero(inside & (kind > 0))
    unit = unit_of_word[np.searchsorted(start, letters, side="right") - 1]
    new = np.ones(len(unit), bool)
    new[1:] = unit[1:] != unit[:-1]
    begin = np.flatnonzero(new)
    return kind[letters], begin, doc[unit[begin]]


def _distinct(letters: np.ndarray, begin: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(a representative of each distinct unit, the distinct unit of each unit)."""
    up, down = POWERS.upto(len(letters) + 1)
    sums = np.concatenate([[U64(0)], np.cumsum(mix(letters.astype(U64)) * up[: len(letters)])])
    end = np.append(begin[1:], len(letters))
    _, first, place = np.unique(mix((sums[end] - sums[begin]) * down[begin]), return_index=True, return_inverse=True)
    return first, place


def _features(letters: np.ndarray, unit: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray, float]]:
    """(unit, subsequence, weight) of all occurrences, by gaps."""
    wide = letters.astype(np.int64)
    for i, k in GAPS:
        if len(letters) <= k:
            continue
        same = unit[:-k] == unit[k:]
        code = (wide[:-k] * CLASSES + wide[i : len(wide) - k + i]) * CLASSES + wide[k:]
        yield unit[:-k][same], code[same], DECAY ** (k - 2)


def _norms(at: np.ndarray, code: np.ndarray, weight: np.ndarray, n: int) -> np.ndarray:
    """Length of each unit's vector; a subsequence that occurs again adds to its weight before it is squared."""
    key, place = np.unique(at * CLASSES**3 + code, return_inverse=True)
    return np.sqrt(np.bincount(key // CLASSES**3, weights=np.bincount(place, weights=weight) ** 2, minlength=n)) if len(key) else np.zeros(n)


def decide(letters: np.ndarray, unit: np.ndarray, n: int, table: np.ndarray, bias: float) -> np.ndarray:
    """The machine's decision for each of n units."""
    found = list(_features(letters, unit))
    if not found:
        return np.full(n, bias)
    at, code = (np.concatenate([f[k] for f in found]) for k in (0, 1))
    weight = np.concatenate([np.full(len(f[0]), f[2]) for f in found])
    total = np.bincount(at, weights=weight * table[code], minlength=n)
    return total / np.maximum(_norms(at, code, weight, n), 1e-9) + bias


def document_features(data: np.ndarray, offs: np.ndarray, table: np.ndarray, bias: float) -> np.ndarray:
    """Per text: three highest decisions, positive units (log) and their share (root)."""
    n = len(offs) - 1
    out = np.full((n, 5), ABSENT)
    out[:, 3:] = 0
    letters, begin, doc = units(data, offs)
    if not len(begin):
        return out
    first, place = _distinct(letters, begin)
    end = np.append(begin[1:], len(letters))
    size = (end - begin)[first]
    pick = np.repeat(begin[first] - np.concatenate([[0], np.cumsum(size)[:-1]]), size) + np.arange(size.sum())
    value = decide(letters[pick], np.repeat(np.arange(len(first)), size), len(first), table, bias)[place]
    value = np.maximum(value, ABSENT)
    order = np.lexsort((-value, doc))
    rank = np.arange(len(order)) - np.searchsorted(doc[order], doc[order], side="left")
    for k in range(3):
        top = order[rank == k]
        out[doc[top], k] = value[top]
    positive = np.bincount(doc, weights=value > 0, minlength=n)
    out[:, 3] = np.log1p(positive)
    out[:, 4] = np.sqrt(positive / np.maximum(1, np.bincount(doc, minlength=n)))
    return out


# Fitting, over bounded samples: each machine in a task of its own, the logistic weights on the driver.


def _sparse(unit: str) -> dict[int, float]:
    """The unit's vector, of length 1."""
    letters = np.array([ord(c) - 64 for c in unit], np.uint8)
    out: dict[int, float] = {}
    for _, codes, weight in _features(letters, np.zeros(len(letters), np.int64)):
        for c in codes.tolist():
            out[c] = out.get(c, 0.0) + weight
    norm = sum(v * v for v in out.values()) ** 0.5
    return {c: v / norm for c, v in out.items()}


def folded(marks: list[dict[int, float]], coefficients: np.ndarray) -> np.ndarray:
    """One table over subsequences for the sum of kernel values with landmarks, each times its coefficient."""
    table = np.zeros(CLASSES**3, np.float32)
    for mark, coefficient in zip(marks, coefficients.tolist(), strict=True):
        for code, value in mark.items():
            table[code] += coefficient * value
    return table


def _linear_svm(x: np.ndarray, y: np.ndarray, cost: np.ndarray, rounds: int = ROUNDS) -> np.ndarray:
    """L2-regularised hinge loss by dual coordinate descent; the last column of x is the constant."""
    w, alpha = np.zeros(x.shape[1]), np.zeros(len(x))
    square = (x * x).sum(axis=1)
    rng = np.random.default_rng(5)
    for _ in range(rounds):
        for i in rng.permutation(len(x)):
            gradient = y[i] * (x[i] @ w) - 1
            new = min(max(alpha[i] - gradient / square[i], 0.0), cost[i])
            if new != alpha[i]:
                w += (new - alpha[i]) * y[i] * x[i]
                alpha[i] = new
    return w


def _logistic(x: np.ndarray, y: np.ndarray, weight: np.ndarray, ridge: float = 1e-2) -> np.ndarray:
    """Ridge-penalised logistic regression by Newton steps; the last coefficient is the constant."""
    x = np.hstack([x, np.ones((len(x), 1))])
    w = np.zeros(x.shape[1])
    for _ in range(30):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        slope = x.T @ (weight * (p - y)) + ridge * w
        curve = (x * (weight * p * (1 - p))[:, None]).T @ x + ridge * np.eye(len(w))
        step = np.linalg.solve(curve, slope)
        w -= step
        if np.abs(step).max() < 1e-6:
            break
    return w


class Machine:
    """A fitted SVM as one table over subsequences, and the logistic weights of texts."""

    def __init__(self, table: np.ndarray, bias: float) -> None:
        self.table, self.bias, self.weights = table, bias, np.zeros(6)

    def score(self, features: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(features @ self.weights[:-1] + self.weights[-1], -30, 30)))


def _machine(positive: list[str], negative: list[str], groups: list[int]) -> Machine | None:
    """The SVM from positive units, with their groups as evidence, and negative units; most telling first."""
    if not positive or not negative:
        return None
    half = LANDMARKS // 2
    marks = [_sparse(u) for u in positive[: max(half, LANDMARKS - len(negative))] + negative[: max(half, LANDMARKS - len(positive))]]
    column: dict[int, int] = {}
    for mark in marks:
        for code in mark:
            column.setdefault(code, len(column))
    basis = np.zeros((len(column), len(marks)))
    for k, mark in enumerate(marks):
        for code, value in mark.items():
            basis[column[code], k] = value
    values, vectors = np.linalg.eigh(basis.T @ basis)
    keep = values > 1e-6 * values.max()
    whiten = vectors[:, keep] / np.sqrt(values[keep])
    project = basis @ whiten
    z = np.ones((len(positive) + len(negative), project.shape[1] + 1))
    for row, unit in enumerate(positive + negative):  # one by one: all units by all subsequences would be a large matrix
        shared = {column[code]: value for code, value in _sparse(unit).items() if code in column}
        z[row, :-1] = np.array(list(shared.values())) @ project[list(shared)] if shared else 0.0
    y = np.where(np.arange(len(z)) < len(positive), 1.0, -1.0)
    cost = np.concatenate([COST * np.minimum(groups, MOST_GROUPS), np.full(len(negative), NEGATIVE_COST)])
    w = _linear_svm(z, y, cost)
    return Machine(folded(marks, whiten @ w[:-1]), float(w[-1]))


def _sample(docs: DataFrame, labels: DataFrame, held_out: Column) -> DataFrame:
    """(text, toxic, part) of the sample, equal texts once; part 0 fits the machine, part 1 the logistic weights."""
    known = labels.where(F.col("doc_id").isNotNull() & F.col("toxic").isNotNull() & ~F.coalesce(held_out, F.lit(False)))
    known = known.groupBy("doc_id").agg((F.max("toxic") > 0).cast("int").alias("toxic"))
    pick = lambda kind, most: known.where(F.col("toxic") == kind).orderBy(F.xxhash64("doc_id"), "doc_id").limit(most)
    ids = stored(pick(1, SAMPLE_TOXIC).union(pick(0, SAMPLE_CLEAN)), "toxicity-ids")
    texts = docs.select("doc_id", "text").where("text IS NOT NULL").join(F.broadcast(ids), "doc_id")
    return stored(texts.groupBy("text").agg(F.max("toxic").alias("toxic")).withColumn("part", F.pmod(F.xxhash64("text"), F.lit(2)).cast("int")), "toxicity-sample")


def _unit_counts(sample: DataFrame) -> DataFrame:
    """(unit, toxic_0, clean_0, toxic_1, clean_1): groups of near-copies that hold each unit, by class and part.

    A text's group is the least hash of its runs of three units, which near-copies mostly share. One shuffle by unit
    serves both counts.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            toxic, part = np.asarray(batch.column(1)), np.asarray(batch.column(2))
            for row, _, data, offs in chunks(batch.column(0), CHUNK_BYTES):
                letters, begin, doc = units(data, offs)
                if not len(begin):
                    continue
                text = (letters + 64).tobytes().decode("latin-1")
                end = np.append(begin[1:], len(letters))
                _, place = _distinct(letters, begin)
                up, down = POWERS.upto(len(letters) + 1)
                sums = np.concatenate([[U64(0)], np.cumsum(mix(letters.astype(U64)) * up[: len(letters)])])
                name = mix((sums[end] - sums[begin]) * down[begin])
                start = np.flatnonzero(np.append(True, doc[1:] != doc[:-1]))
                length = np.diff(np.append(start, len(doc)))
                runs = np.append(name, [U64(0)] * 2)
                runs = mix(runs[:-2] + mix(runs[1:-1] + mix(runs[2:])))
                inner = np.arange(len(doc)) + 2 < np.repeat(start + length, length)  # runs that end in their text
                inner[start[length < 3]] = True
                group = np.minimum.reduceat(np.where(inner, runs, np.iinfo(U64).max), start)
                _, first = np.unique(np.stack([doc, place]), axis=1, return_index=True)
                d = row + doc[first]
                spelt = [text[a:b] for a, b in zip(begin[first].tolist(), end[first].tolist(), strict=True)]
                own = np.repeat(group, length)[first]
                yield pa.RecordBatch.from_arrays([pa.array(spelt, pa.string()), pa.array(own.view(np.int64)), pa.array(toxic[d].astype(np.int32)), pa.array(part[d].astype(np.int32))], names=["unit", "group", "toxic", "part"])

    seen = sample.select("text", "toxic", "part").mapInArrow(run, "unit string, group long, toxic int, part int").repartition("unit")
    has = {f"{kind}_{p}": (F.col("toxic") == t) & (F.col("part") == p) for p in (0, 1) for t, kind in ((1, "toxic"), (0, "clean"))}
    groups = seen.groupBy("unit", "group").agg(*[F.max(c.cast("int")).alias(k) for k, c in has.items()])
    return groups.groupBy("unit").agg(*[F.sum(k).alias(k) for k in has])


def _with_features(rows: DataFrame, machine: Machine, columns: str) -> DataFrame:
    """Columns before the text (last) with features; `columns` is their schema."""
    shared = rows.sparkSession.sparkContext.broadcast(machine)
    names = [c.split()[0] for c in columns.split(", ")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = shared.value
        for batch in batches:
            last = batch.num_columns - 1
            for row, end, data, offs in chunks(batch.column(last), CHUNK_BYTES):
                features = document_features(data, offs, model.table, model.bias)
                flat = pa.ListArray.from_arrays(pa.array(np.arange(0, features.size + 1, 5, dtype=np.int32)), pa.array(features.ravel()))
                yield pa.RecordBatch.from_arrays([*(batch.column(c).slice(row, end - row) for c in range(last)), flat, pa.array(model.score(features))], names=[*names, "features", "score"])

    return rows.mapInArrow(run, f"{columns}, features array<double>, score double")


def fit(docs: DataFrame, labels: DataFrame, held_out: Column) -> Machine | None:
    """A machine from the labels of rows that are not held out; `held_out` is a condition over labels.doc_id."""
    sample = _sample(docs, labels, held_out)
    kinds = [(p, t) for p in (0, 1) for t in (0, 1)]
    totals = dict(zip(kinds, sample.agg(*[F.count_if((F.col("part") == p) & (F.col("toxic") == t)) for p, t in kinds]).collect()[0], strict=True))
    if not all(totals.values()):
        return None
    counts = stored(_unit_counts(sample), "toxicity-units")
    machines = _machines(counts, totals, [(0,), (1,), (0, 1)])
    x, y = [], []
    for part in (0, 1):
        if (part,) not in machines:
            continue
        learnt = _with_features(sample.where(F.col("part") == 1 - part).select("toxic", "text"), machines[part,], "toxic int").select("toxic", "features").collect()
        x += [r["features"] for r in learnt]
        y += [r["toxic"] for r in learnt]
    machine = machines.get((0, 1))
    if machine is None or not x:
        return None
    machine.weights = _logistic(np.array(x), np.array(y, np.float64), np.ones(len(y)))
    return machine


def _machines(counts: DataFrame, totals: dict, folds: list[tuple[int, ...]]) -> dict[tuple[int, ...], Machine]:
    """The machine of each fold (some parts), fitted by a task each: units and matrices stay off the driver, which gets
    the entries of the table that are not 0. Folds without units of both kinds have none."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows = [row for batch in batches for row in zip(*(c.to_pylist() for c in batch.columns), strict=True)]
        rows.sort(key=lambda r: (r[1], r[3] if r[1] == 2 else -r[3], r[2]))
        positive = [r for r in rows if r[1] == 0]
        machine = _machine([r[2] for r in positive], list(dict.fromkeys(r[2] for r in rows if r[1])), [r[3] for r in positive])
        if machine is not None:
            codes = np.flatnonzero(machine.table).astype(np.int32)
            parts = [rows[0][0]], [codes.tobytes()], [machine.table[codes].tobytes()], [machine.bias]
            yield pa.RecordBatch.from_arrays([pa.array(v, t) for v, t in zip(parts, (pa.int32(), pa.binary(), pa.binary(), pa.float64()), strict=True)], names=["fold", "codes", "weights", "bias"])

    fitted = [_instances(counts, totals, parts, k).coalesce(1).mapInArrow(run, "fold int, codes binary, weights binary, bias double") for k, parts in enumerate(folds)]
    out = {}
    for r in reduce(DataFrame.union, fitted).collect():
        table = np.zeros(CLASSES**3, np.float32)
        table[np.frombuffer(r["codes"], np.int32)] = np.frombuffer(r["weights"], np.float32)
        out[folds[r["fold"]]] = Machine(table, r["bias"])
    return out


def _instances(counts: DataFrame, totals: dict, parts: tuple[int, ...], fold: int) -> DataFrame:
    """(fold, kind, unit, n) of what some parts teach, most telling first: kind 0, positive units, by their groups n, at
    most MOST_POSITIVE; negative ones, 1 by their groups n and 2 by a hash n, together at most MOST_NEGATIVE."""
    toxic, clean = (sum(F.col(f"{kind}_{p}") for p in parts) for kind in ("toxic", "clean"))
    n_toxic, n_clean = (sum(totals[p, t] for p in parts) for t in (1, 0))
    seen = counts.select("unit", toxic.alias("t"), clean.alias("c")).withColumn("lift", (F.col("t") / n_toxic) / ((F.col("c") + 1) / n_clean))
    # How surprising so many toxic groups are, if the unit said nothing: t log(t / expected), in nats.
    surprise = F.col("t") * F.log(F.col("t") * (n_toxic + n_clean) / ((F.col("t") + F.col("c")) * float(n_toxic)))
    telling = seen.where(f"t >= {LEAST_GROUPS} AND lift > 5 AND length(unit) > 2").where(surprise > SURPRISE)
    plain = seen.where("c > 0 AND lift < 2 AND length(unit) > 2").withColumn("hash", F.xxhash64("unit"))
    first = lambda of, kind, n, order, most: of.orderBy(order, "unit").limit(most).select(F.lit(fold).alias("fold"), F.lit(kind).alias("kind"), "unit", F.col(n).alias("n"))
    positive = first(telling, 0, "t", F.desc("t"), MOST_POSITIVE)
    return positive.union(first(plain, 1, "c", F.desc("c"), MOST_NEGATIVE // 2)).union(first(plain, 2, "hash", "hash", MOST_NEGATIVE // 2))


def score_documents(docs: DataFrame, machine: Machine | None, threshold: float = THRESHOLD) -> DataFrame:
    """(doc_id, score, predicted) of every text; one pass, no shuffle."""
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    scored = rows.select("doc_id", F.lit(0.0).alias("score")) if machine is None else _with_features(rows, machine, "doc_id long").select("doc_id", "score")
    return scored.withColumn("predicted", (F.col("score") >= threshold).cast("int"))


def keep_clean(docs: DataFrame, machine: Machine | None, threshold: float = THRESHOLD) -> DataFrame:
    """`docs` (doc_id, text, lang, source, n_chars) without the rows that score at or above the threshold."""
    if machine is None:
        return docs
    rows = docs.select("doc_id", "lang", "source", "n_chars", F.col("text").alias("kept"), "text")
    scored = _with_features(rows, machine, "doc_id long, lang string, source string, n_chars long, kept string")
    return scored.where(F.col("score") < threshold).select("doc_id", F.col("kept").alias("text"), "lang", "source", "n_chars")
