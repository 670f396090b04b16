"""The pipeline against a plain version of its stages."""

import random
import re
from collections import Counter, defaultdict

import pytest
from pyspark.sql import functions as F

corpus_pipeline = pytest.importorskip("corpus_pipeline")

WORD = re.compile(r"[^\x20\x09-\x0D]+")


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    rng = random.Random(12)
    word = lambda: "".join(rng.choice("abcdeinorst") for _ in range(rng.randint(2, 7)))
    texts, toxic = [], []
    for i in range(700):
        words = [word() for _ in range(rng.randint(8, 60))]
        toxic.append(int(i % 4 == 0))
        for _ in range(3 * toxic[-1]):
            words.insert(rng.randrange(len(words)), rng.choice(["blarghead", "snorfwit"]))
        if i % 10 == 1:
            words.insert(4, "password=e3b3ed3cc8548923d6")
        texts.append(" ".join(words))
    texts += [texts[1], texts[2], " ".join([*texts[3].split(" ")[:-1], "other"]), "", ""]
    toxic += [0] * 5
    rows = [(i, t, "en", f"s{i % 3}", len(t)) for i, t in enumerate(texts)]
    path = tmp_path_factory.mktemp("sf")
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{path}/documents.parquet")
    spark.createDataFrame(list(enumerate(toxic)), "doc_id long, toxic int").withColumn("quality", F.lit(1)).write.parquet(f"{path}/labels.parquet")
    return str(path), texts, toxic


def survivors(texts, gone):
    """Smallest doc_id of each near-duplicate group among documents that stay."""
    sets = {}
    for i, t in enumerate(texts):
        if i not in gone:
            w = WORD.findall(t)
            sets[i] = {tuple(w[k : k + 5]) for k in range(max(1, len(w) - 4))} if w else set()
    up = {i: i for i in sets}

    def find(x):
        while up[x] != x:
            x = up[x]
        return x

    for i in sets:
        for j in sets:
            both = len(sets[i] & sets[j])
            if i < j and both and 100 * both >= 75 * len(sets[i] | sets[j]):
                a, b = find(i), find(j)
                up[max(a, b)] = min(a, b)
    return {i for i in sets if find(i) == i}


def test_stages(spark, folder):
    path, texts, toxic = folder
    docs = spark.read.parquet(f"{path}/documents.parquet")
    assert [n for n, _ in corpus_pipeline.STAGES] == ["toxicity", "near_dedup", "secrets", "mix", "pack"]
    seen = []
    for k, (_, stage) in enumerate(corpus_pipeline.STAGES):
        docs = stage(spark, docs, path)
        out = f"{path}/stage-{k}"
        docs.write.parquet(out)
        docs = spark.read.parquet(out)
        seen.append(docs.collect())
        if k < 4:
            assert docs.columns == ["doc_id", "text", "lang", "source", "n_chars"]
    gone = set(range(len(texts))) - {r["doc_id"] for r in seen[0]}
    wrong = [i for i in range(len(texts)) if (i in gone) != bool(toxic[i])]
    assert len(wrong) <= 0.02 * len(texts)
    kept = survivors(texts, gone)
    assert sorted(r["doc_id"] for r in seen[1]) == sorted(kept)
    plain = {i: re.sub(r"password=[A-Za-z0-9+/_.=-]{12,}", "[SECRET]", texts[i]) for i in kept}
    assert {r["doc_id"]: (r["text"], r["n_chars"]) for r in seen[2]} == {i: (t, len(t)) for i, t in plain.items()}
    size = {i: len(WORD.findall(t)) for i, t in plain.items()}
    copies = Counter(r["doc_id"] for r in seen[3])
    taken = defaultdict(int)
    for i, n in copies.items():
        assert n <= 3
        taken[i % 3] += n * size[i]
    total = sum(size.values())
    longest = max(size.values())
    assert total - 3 * longest <= sum(taken.values()) <= total
    for s in range(3):
        assert abs(taken[s] - total * (s + 1) / 6) <= longest
    packed = Counter()
    by_bin = defaultdict(list)
    for r in seen[4]:
        packed[r["doc_id"]] += r["n_words"]
        by_bin[r["bin"]].append(r)
    assert +packed == +Counter({i: n * size[i] for i, n in copies.items()})
    for pieces in by_bin.values():
        assert sum(p["n_words"] for p in pieces) <= 2048 and len({p["cluster"] for p in pieces}) == len(pieces)
    assert sorted(map(tuple, corpus_pipeline.run(spark, path).collect())) == sorted(map(tuple, seen[4]))


def test_one_row_of_each_group_stays(spark):
    text, other = "one two three four five six seven eight nine ten eleven twelve", "quite another text with nothing in common at all here"
    rows = [(5, text), (5, text), (7, text + " more"), (None, text), (None, other), (None, other), (9, None), (9, None), (10, ""), (11, other.upper()), (11, "a third text under one number is linked with it too")]
    docs = spark.createDataFrame([(i, t, "en", "s", 0, "x") for i, t in rows], "doc_id long, text string, lang string, source string, n_chars long, kept string")
    out = corpus_pipeline.drop_near_duplicates(spark, docs, "")
    assert out.columns == ["doc_id", "text", "lang", "source", "n_chars"]
    found = sorted(((r["doc_id"], r["text"]) for r in out.collect()), key=str)
    assert found == sorted([(5, text), (9, None), (10, ""), (11, other.upper())], key=str)


def test_odd_tables(spark, tmp_path):
    """Empty tables, and null, empty and very long texts with repeated rows, through all stages."""
    schema = "doc_id long, text string, lang string, source string, n_chars long"
    rng = random.Random(2)
    words = ["".join(rng.choice("abcdeinorst") for _ in range(5)) for _ in range(40_000)]
    rows = [(1, None, None, None, None), (1, None, None, None, None), (2, "", "en", "a", 0), (None, "some words", "en", "a", 10), (3, " ".join(words), "en", "b", 1), (4, "token=abcdefghijklmnop " + " ".join(words[:50]), "en", "a", 1)]
    for name, made in (("none", []), ("odd", rows)):
        path = f"{tmp_path}/{name}"
        spark.createDataFrame(made, schema).write.parquet(f"{path}/documents.parquet")
        spark.createDataFrame([], "doc_id long, quality int, toxic int").write.parquet(f"{path}/labels.parquet")
        packed = corpus_pipeline.run(spark, path).collect()
        if not made:
            assert packed == []
        else:
            assert {r["doc_id"] for r in packed} >= {1, 2} and sum(r["n_words"] for r in packed if r["doc_id"] == 3) % 40_000 == 0


def test_only_the_result_is_left(spark, folder):
    from pathlib import Path

    from tesserae.llm._store import shared_dir

    base = Path(shared_dir(spark).removeprefix("file://")) / "tesserae"
    before = set(base.iterdir()) if base.exists() else set()
    packed = corpus_pipeline.run(spark, folder[0])
    assert packed.count() > 0
    assert [p.name.rsplit("-", 1)[0] for p in set(base.iterdir()) - before] == ["pipeline-pack"]
