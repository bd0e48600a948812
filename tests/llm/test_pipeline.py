"""The pipeline on a small corpus: each stage's rows against a plain version of it, on what its predecessor kept."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

import corpus_pipeline
from quillon.llm import bpe, mixing, quality, toxicity
from quillon.llm.tokens import tokenizer_path

from plain import jaccard_components, repeated_words, words_of

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


def corpus():
    rng = random.Random(11)
    word = lambda: "".join(rng.choice(["an", "el", "or", "ti", "mo", "su", "re"]) for _ in range(rng.randrange(1, 5)))
    rows, labels = [], []
    for k in range(420):
        words = [word() for _ in range(rng.randrange(30, 120))]
        toxic = k % 5 == 0
        if toxic:
            for _ in range(2):
                words[rng.randrange(len(words))] = rng.choice(["vizgrub", "klompzak"])
        rows.append([k, " ".join(words), rng.choice(["en", None]), rng.choice(["a", "a", "b", None])])
        if k < 300:
            labels.append((k, 1, int(toxic)))
    rows += [[1000 + k, rows[k][1] if k % 2 else rows[k][1] + " one more", "en", "a"] for k in range(1, 60)]  # copies
    rows += [[2000, None, "en", "a"], [2001, "", "en", "b"], [2002, "too short", "en", "b"], [2003, "a b c d e f g h " * 30, "en", "a"], [3, rows[3][1], rows[3][2], rows[3][3]], [None, rows[7][1] + " x", "en", "b"]]
    rows += [[3000 + k, " ".join(word() + "$$$" for _ in range(60)), "en", "a"] for k in range(20)]
    return [(*r, None if r[1] is None else len(r[1])) for r in rows], labels


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    rows, labels = corpus()
    path = tmp_path_factory.mktemp("corpus")
    spark.createDataFrame(rows, SCHEMA).repartition(3).write.parquet(f"{path}/documents.parquet")
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"{path}/labels.parquet")
    return str(path)


def ids(frame):
    return sorted(str(r.doc_id) for r in frame.select("doc_id").collect())


def test_stages_in_turn(spark, folder):
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    names = [name for name, _ in corpus_pipeline.STAGES]
    assert names == ["quality rules", "toxicity", "near duplicates", "mixing", "bpe"]
    stages = dict(corpus_pipeline.STAGES)

    kept = spark.createDataFrame(stages["quality rules"](spark, docs, folder).collect(), SCHEMA)
    judged = {(r.doc_id, r.n_words): r.kept for r in quality.judge(docs).collect()}
    assert ids(kept) == sorted(str(r.doc_id) for r in docs.collect() if judged[r.doc_id, len(words_of(r.text))])
    gone = set(ids(docs)) - set(ids(kept))
    for r in docs.collect():  # the base limits by hand
        n = len(words_of(r.text))
        if n < 20 or 100 * repeated_words(words_of(r.text), 8) > 30 * n:
            assert str(r.doc_id) in gone
    assert {str(3000 + k) for k in range(20)} <= gone

    polite = spark.createDataFrame(stages["toxicity"](spark, kept, folder).collect(), SCHEMA)
    said = [r.doc_id for r in kept.collect() if {"vizgrub", "klompzak"} & set(words_of(r.text))]
    assert not set(map(str, said)) & set(ids(polite)) and polite.count() >= kept.count() - len(said) - 2

    single = spark.createDataFrame(stages["near duplicates"](spark, polite, folder).collect(), SCHEMA)
    component = jaccard_components([(r.doc_id, r.text) for r in polite.collect() if r.doc_id is not None])
    assert ids(single) == sorted([str(d) for d in component if component[d] == d] + ["None"] * polite.where("doc_id is null").count())

    mixed = spark.createDataFrame(stages["mixing"](spark, single, folder).collect(), SCHEMA)
    copies = {r.doc_id: r.copies for r in mixing.mix(single).collect()}
    assert ids(mixed) == sorted(str(d) for d, n in copies.items() for _ in range(n))
    assert mixed.columns == docs.columns

    out = stages["bpe"](spark, mixed, folder).collect()
    model = Tokenizer.from_file(tokenizer_path(bpe.TOKENIZER))
    counts = sorted((str(r.doc_id), len(model.encode(r.text, add_special_tokens=False).ids)) for r in mixed.collect())
    assert sorted((str(r.doc_id), r.n_tokens) for r in out) == counts


def test_run_is_its_stages_and_takes_empty_tables(spark, folder, tmp_path):
    whole = corpus_pipeline.run(spark, folder)
    assert 0 < whole.count() and set(whole.columns) >= {"doc_id", "n_tokens"}
    for name in ("documents", "labels"):
        spark.read.parquet(f"{folder}/{name}.parquet").limit(0).write.parquet(f"{tmp_path}/{name}.parquet")
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == 0


def test_other_columns_go_along(spark, folder):
    docs = spark.read.parquet(f"{folder}/documents.parquet").limit(40)
    for name in ("id", "row", "grp", "k_lang", "distance", "score", "__gone", "__copies", "m_n", "n_words"):
        docs = docs.withColumn(name, F.lit("clash"))
    for name, stage in corpus_pipeline.STAGES[:-1]:
        assert stage(spark, docs, folder).columns == docs.columns, name


def test_scores_are_the_kernel_expansion_over_landmarks():
    """One weight per subsequence gives what the landmarks' kernels give, by plain dictionaries."""
    landmarks, words = ["vizgrub", "klompzak", "anelor", "the"], ["vizxgrub", "klompzak", "soret", "a", "vizgrubs"]
    beta = np.array([1.5, -0.5, 0.25, 2.0])

    def vector(word):
        code = [0] + [ord(c) - 96 for c in word] + [27]
        out = {}
        for i in range(len(code)):
            for j in range(i + 1, len(code)):
                for k in range(j + 1, min(len(code), i + toxicity.SPAN)):
                    key = (code[i], code[j], code[k])
                    out.setdefault(key, []).append(toxicity.DECAY ** (k - i - 2))
        norm = np.sqrt(sum(x * x for v in out.values() for x in v))
        return {k: sum(v) / norm for k, v in out.items()}

    plain = [sum(b * sum(x * vector(m).get(k, 0.0) for k, x in vector(w).items()) for b, m in zip(beta, landmarks)) for w in words]
    kernels = toxicity.kernel(words, landmarks) @ beta
    weight = np.zeros(toxicity.DIMENSIONS)
    for b, m in zip(beta, landmarks):
        entries, value = toxicity.subsequences([m], len(m))
        np.add.at(weight, entries[0], b * value)
    assert np.allclose(kernels, plain, atol=1e-4) and np.allclose(toxicity.weighted(words, weight), plain, atol=1e-4)


def test_flat_trees_give_what_a_walk_of_each_row_gives():
    from quillon.llm import trees

    rng = np.random.default_rng(2)
    x = rng.normal(size=(400, 6))
    forest = trees.fit(x, (x[:, 1] * x[:, 4] > 0).astype(float), n_trees=12)
    inner = forest.feature.shape[1]
    for row, margin in zip(x, forest.margins(x)):
        total = forest.start
        for t in range(len(forest.feature)):
            node = 0
            while node < inner:
                node = 2 * node + 1 + (row[forest.feature[t, node]] > forest.threshold[t, node])
            total += forest.leaf[t, node - inner]
        assert abs(total - margin) < 1e-9


def test_first_cut_of_a_tree_is_the_best_of_all_cuts():
    from quillon.llm import trees

    rng = np.random.default_rng(4)
    x = rng.integers(0, 12, (300, 3)).astype(float)
    y = (x[:, 1] > 6).astype(float)
    y[rng.integers(0, 300, 30)] = 1 - y[rng.integers(0, 300, 30)]
    forest = trees.fit(x, y, n_trees=1, depth=1, rate=1.0)
    p = (y.sum() + 0.5) / (len(y) + 1)
    g, h = p - y, np.full(len(y), p * (1 - p))
    gain = lambda m: g[m].sum() ** 2 / (h[m].sum() + 1) if m.any() else 0.0
    every = {(f, c): gain(x[:, f] <= c) + gain(x[:, f] > c) for f in range(3) for c in np.unique(x[:, f]) if 1 <= h[x[:, f] <= c].sum() and 1 <= h[x[:, f] > c].sum()}
    cut = (int(forest.feature[0, 0]), float(forest.threshold[0, 0]))
    got = gain(x[:, cut[0]] <= cut[1]) + gain(x[:, cut[0]] > cut[1])
    assert got >= max(every.values()) - 1e-6


def test_kept_documents_against_plain_estimates(spark):
    """op7 end to end: exact half samples, from many random starts, in numpy."""
    rows, _ = corpus()
    docs = spark.createDataFrame([r for r in rows if r[0] is not None], SCHEMA)
    judged = quality.judge(docs).collect()
    vectors = np.array([[np.log((r.word_chars + 250) / (r.n_words + 50)), np.arcsinh(10 * r.n_symbols / (r.n_words + 50)), np.sqrt(20 * r.n_dup_lines / (r.n_words + 100)), np.sqrt(r.n_repeat_words / (r.n_words + 50))] for r in judged])
    source = {r[0]: (r[2], r[3]) for r in rows}
    rng = np.random.default_rng(0)
    floors = np.diag(np.square(quality.FLOORS))
    good = np.array([not r.base_failed for r in judged])

    def estimate(x):
        best = None
        n = int(np.floor(quality.H * len(x)))
        for _ in range(12):
            own = x[rng.permutation(len(x))[:30]]
            for _ in range(15):
                center, cov = own.mean(axis=0), np.cov(own.T, bias=True) * quality.consistency(quality.H) + floors
                d = np.einsum("ni,ij,nj->n", x - center, np.linalg.inv(cov), x - center)
                own = x[np.argsort(d, kind="stable")[:n]]
            center, cov = own.mean(axis=0), np.cov(own.T, bias=True) * quality.consistency(quality.H) + floors
            if best is None or np.linalg.det(cov) < best[0]:
                best = np.linalg.det(cov), center, np.linalg.inv(cov)
        return best[1:]

    keys = [source[r.doc_id] for r in judged]
    sizes = {k: sum(good[i] for i, x in enumerate(keys) if x == k) for k in set(keys)}
    langs = {k[0]: sum(good[i] for i, x in enumerate(keys) if x[0] == k[0]) for k in set(keys)}
    wrong = 0
    for key in set(keys):
        own = sizes[key] >= quality.MIN_GROUP
        group = [good[i] and (keys[i] == key if own else keys[i][0] == key[0] if langs[key[0]] >= quality.MIN_GROUP else True) for i in range(len(keys))]
        center, inverse = estimate(vectors[np.array(group)])
        for i, r in enumerate(judged):
            if keys[i] == key:
                d = (vectors[i] - center) @ inverse @ (vectors[i] - center)
                if not 0.8 < d / quality.CUTOFF < 1.25:  # bins of distance may move the line a little
                    wrong += bool(good[i] and d <= quality.CUTOFF) != r.kept
    assert wrong == 0
