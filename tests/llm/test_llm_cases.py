"""Nulls in any column, repeated rows and ids, ties, and extra columns with names that the operators use themselves."""

import pytest
from pyspark.sql import functions as F

from geoweave.llm import bytebpe, hostrules, knn, licenses, mixture, neardup, ngram, quality, substring, tokenfiles

import public_tokenizers as P

LONG = " ".join(f"word{i}" for i in range(40))


@pytest.fixture(scope="module")
def odd(spark):
    """Null ids, a repeated row, one id with two texts, and clashing columns."""
    rows = [(1, LONG, "s"), (1, LONG, "s"), (2, LONG, None), (None, LONG, "s"), (3, None, "t"), (3, "short text", "t"), (4, LONG + " " + LONG, "t")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string")
    return docs.select("*", *[F.lit(1).alias(c) for c in ("size", "target", "copies", "n_words", "places", "spot", "label", "kept", "host", "of", "rest")])


def test_near_duplicates(odd):
    got = sorted(((r.doc_id, r.n_shingles, r.component_id, r.kept) for r in neardup.near_duplicates(odd, k=4).collect()), key=str)
    assert got == sorted([(1, 37, 1, True), (1, 37, 1, True), (2, 37, 1, False), (None, 37, None, True), (3, 0, 3, True), (3, 1, 3, True), (4, 40, 1, False)], key=str)


def test_substrings(odd):
    got = {(r.doc_id, r.n_words, r.n_removed) for r in substring.dedup_substrings(odd, length=13).collect()}
    assert got == {(1, 40, 0), (2, 40, 40), (None, 40, 0), (3, 0, 0), (3, 2, 0), (4, 80, 80)}


def test_mix(odd):
    got = mixture.repetition_plan(odd).collect()
    assert len(got) == 7 and all(0 <= r.copies <= 2 for r in got)
    mixed = mixture.mix_sources(odd).groupBy("doc_id").count().collect()
    assert sum(r["count"] for r in mixed) == sum(r.copies for r in got)


def test_hosts(odd):
    assert len(hostrules.judge(odd.drop("host").withColumnRenamed("source", "host")).collect()) == 7
    kept = hostrules.keep_documents(odd, host="source")
    assert kept.columns == odd.columns and kept.count() == 4


def test_tokens(spark, odd):
    assert sorted(r.n_tokens for r in tokenfiles.token_round_trip(odd, P.path("byte_bpe_50k.json"), 0).collect())[:2] == [1, 3]
    coded = bytebpe.encode_decode(odd, P.path("byte_bpe_50k.tiktoken"), P.PATTERN)
    assert coded.count() == 7 and set(coded.schema["rest"].dataType.fieldNames()) == set(odd.columns) - {"text"}


def test_scores(odd):
    assert ngram.score_texts(odd.withColumn("held_out", F.lit(False)), odd.select("text")).count() == 7
    model = quality.train(odd, odd.select("doc_id", F.lit(1).alias("label")))
    assert quality.score_quality(odd, model).count() == 7
    assert [r.score for r in quality.score_quality(odd.limit(1), None).collect()] == [0.5]


def test_licenses(spark):
    docs = spark.createDataFrame([(1, "Released under the MIT License."), (1, "Released under the MIT License."), (None, "released under the mit license"), (2, None), (3, "under the MIT")], "doc_id long, text string")
    assert sorted((str(r.doc_id), r.license) for r in licenses.scan(docs, licenses.TEMPLATES).collect()) == [("1", "mit-line"), ("None", "mit-line")]
    assert licenses.scan(docs, {}).count() == 0


def test_top_k_with_ties_and_odd_vectors(spark):
    rows = [(0, [1.0, 0.0]), (1, [1.0, 0.0]), (2, [1.0, 0.0]), (3, None), (4, [None, 1.0]), (5, [float("inf"), 0.0]), (None, [1.0, 1.0]), (6, [0.5]), (7, [])]
    v = knn.whole_vectors(spark.createDataFrame(rows, "vec_id long, embedding array<float>"), 64.0)
    got = sorted((r.rank, r.vec_id, r.score) for r in knn.top_k(v.where("vec_id = 0"), v, 3).collect())
    assert got == [(1, 1, 4096), (2, 2, 4096), (3, 6, 2048)]


def test_top_k_prunes_without_loss(spark, monkeypatch):
    import numpy as np

    monkeypatch.setattr(knn, "GROUP", 4)
    rng = np.random.default_rng(1)
    centres = rng.normal(size=(6, 5)) * 20
    x = np.concatenate([c + rng.normal(size=(40, 5)) for c in centres])
    v = knn.whole_vectors(spark.createDataFrame([(i, r.tolist()) for i, r in enumerate(x)], "vec_id long, embedding array<double>"), 64.0)
    whole = np.floor(64 * x).astype(np.int64)
    scores = whole[::20] @ whole.T
    want = {(int(q) * 20, k + 1, int(j), int(row[j])) for q, row in enumerate(scores) for k, j in enumerate([j for j in np.lexsort((np.arange(len(row)), -row)) if j != q * 20][:5])}
    assert {(r.query_id, r.rank, r.vec_id, r.score) for r in knn.top_k(v.where("vec_id % 20 = 0"), v, 5).collect()} == want


def test_top_k_sends_few_copies_where_vectors_lie_in_groups(spark, monkeypatch):
    """Share of (vector, group) pairs that are sent; vectors at right angles to each other can't be ruled out."""
    import numpy as np

    monkeypatch.setattr(knn, "GROUP", 8)
    monkeypatch.setattr(knn, "BLOCK", 64)
    rng = np.random.default_rng(4)
    x = np.concatenate([c + rng.normal(size=(60, 8)) for c in rng.normal(size=(8, 8)) * 20])
    v = knn.whole_vectors(spark.createDataFrame([(i, r.tolist()) for i, r in enumerate(x)], "vec_id long, embedding array<double>"), 64.0)
    asked, dealt = knn.routed(v.where("vec_id % 10 = 0"), v, 5)
    cells = asked.select("cell").distinct().count()
    sent = sum(len(r.ids) // 8 for r in dealt.where("chunk = 0").collect())
    assert cells > 3 and sent < 0.5 * cells * len(x)
    whole = np.floor(64 * x).astype(np.int64)
    scores = whole[::10] @ whole.T
    want = {(q * 10, k + 1, int(j), int(row[j])) for q, row in enumerate(scores) for k, j in enumerate([j for j in np.lexsort((np.arange(len(row)), -row)) if j != q * 10][:5])}
    assert {(r.query_id, r.rank, r.vec_id, r.score) for r in knn.top_k(v.where("vec_id % 10 = 0"), v, 5).collect()} == want


def test_top_k_with_repeated_ids_in_small_groups(spark, monkeypatch):
    import numpy as np

    monkeypatch.setattr(knn, "GROUP", 1)
    rng = np.random.default_rng(2)
    x = np.concatenate([c + rng.normal(size=(30, 5)) for c in rng.normal(size=(6, 5)) * 20])
    ids = np.repeat(np.arange(len(x)), np.where(np.arange(len(x)) % 10 == 0, 9, 1))
    v = knn.whole_vectors(spark.createDataFrame([(int(i), x[i].tolist()) for i in ids], "vec_id long, embedding array<double>"), 64.0)
    whole = np.floor(64 * x).astype(np.int64)
    want = []
    for q in range(0, len(x), 10):
        row = whole[ids] @ whole[q]
        best = [j for j in np.lexsort((ids, -row)) if ids[j] != q][:5]
        want += [(q, k + 1, int(ids[j]), int(row[j])) for k, j in enumerate(best)]
    assert sorted((r.query_id, r.rank, r.vec_id, r.score) for r in knn.top_k(v.where("vec_id % 10 = 0"), v, 5).collect()) == sorted(want)


def test_top_k_takes_one_query_of_an_id_whatever_the_order(spark):
    rows = [(0, [1.0, 0.0]), (0, [0.0, 1.0]), (1, [1.0, 0.0]), (2, [0.0, 1.0])]
    both = [knn.whole_vectors(spark.createDataFrame(r, "vec_id long, embedding array<double>").coalesce(1), 64.0) for r in (rows, rows[::-1])]
    first, second = (sorted((r.rank, r.vec_id, r.score) for r in knn.top_k(v.where("vec_id = 0"), v, 2).collect()) for v in both)
    assert first == second


def test_near_duplicates_of_a_chain(spark):
    """Texts of which neighbours are similar and the ends are not: one component, whatever the bucket's order."""
    words = [f"v{i}" for i in range(100)]
    rows = []
    for i in range(12):
        w = list(words)
        for j in range(i * 3):
            w[(j * 37) % 100] = f"c{j}"
        rows.append((100 - i, " ".join(w)))
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    got = {r.doc_id: r.component_id for r in neardup.near_duplicates(docs, k=4).collect()}
    sets = {i: {tuple(t.split()[j : j + 4]) for j in range(97)} for i, t in rows}
    label = {i: i for i in sets}
    for _ in sets:
        for a in sets:
            for b in sets:
                if 100 * len(sets[a] & sets[b]) >= 80 * len(sets[a] | sets[b]):
                    label[a] = label[b] = min(label[a], label[b])
    assert got == label


def plain_pu(x, positive, mean, scale, prior, decay):
    """The non-negative risk as a function of weights, written out."""
    import numpy as np

    x = np.append(np.clip((x - mean) / scale, -8, 8), np.ones((len(x), 1)), axis=1)

    def risk(w):
        z = x @ w
        below = np.logaddexp(0, z).mean() - prior * np.logaddexp(0, z[positive]).mean()
        return prior * np.logaddexp(0, -z[positive]).mean() + max(below, 0) + decay * (w[:-1] ** 2).sum() / 2

    return risk


def test_pu_risk_gradient_and_minimum_against_plain_numbers(spark):
    import numpy as np

    rng = np.random.default_rng(8)
    x = np.concatenate([rng.normal(0.5, 1, (120, 3)), rng.normal(-0.5, 1, (80, 3))]).astype(np.float32)
    positive = np.arange(200) < 50
    rows = spark.createDataFrame([(r.tobytes(), bool(p)) for r, p in zip(x, positive)], "x binary, positive boolean").repartition(5)
    mean, scale = x.mean(axis=0).astype(float), x.std(axis=0).astype(float)
    start = quality.Classifier(mean, scale, np.array([0.3, -0.2, 0.1]), 0.2)
    risk = plain_pu(x.astype(float), positive, mean, scale, 0.4, 1e-4)
    sums = quality.summed(rows, lambda a, b: quality.parts(start, a, b))
    value, negative, gradient, curve = quality.pu_risk(*quality.Sums.both(sums, 4), prior=0.4)
    w = np.array([0.3, -0.2, 0.1, 0.2])
    plain = plain_pu(x.astype(float), positive, mean, scale, 0.4, 0.0)
    assert negative > 0 and abs(value - plain(w)) < 1e-9
    assert np.allclose(gradient, [(plain(w + e) - plain(w - e)) / 2e-5 for e in np.eye(4) * 1e-5], atol=1e-6)
    found = quality.minimised(rows, start, lambda u, p: quality.pu_risk(u, p, 0.4), 25)
    best = np.append(found.weight, found.bias)
    assert all(risk(best) <= risk(best + e) + 1e-6 for e in rng.normal(0, 0.05, (300, 4)))


def test_prior_from_positives_and_unlabelled_rows():
    import numpy as np

    rng = np.random.default_rng(9)
    model = quality.Classifier(np.zeros(1), np.ones(1), np.ones(1), 0.0)
    for share in (0.2, 0.5, 0.9):
        n = 20_000
        x = np.where(rng.random(n) < share, rng.normal(2, 1, n), rng.normal(-2, 1, n))[:, None]
        known = rng.normal(2, 1, 5_000)[:, None]
        counts = quality.histogram(model, np.concatenate([x, known]), np.arange(n + 5_000) >= n)
        counts[: quality.BINS] -= counts[quality.BINS :]
        assert abs(quality.prior_of(counts) - share) < 0.05


def test_quality_of_one_class_and_of_repeated_ids(spark, odd):
    assert quality.train(odd, odd.select("doc_id", F.lit(0).alias("label"))) is None
    assert quality.train(odd.limit(0), odd.select("doc_id", F.lit(1).alias("label"))) is None


def test_one_id_with_two_texts_ties_their_groups(spark):
    """Rows (1, A), (3, A), (3, B), (5, B): document 3 holds both texts, so all are one group."""
    other = " ".join(f"other{i}" for i in range(40))
    docs = spark.createDataFrame([(1, LONG), (3, LONG), (3, other), (5, other), (3, None)], "doc_id long, text string")
    got = sorted((r.doc_id, r.n_shingles, r.component_id, r.kept) for r in neardup.near_duplicates(docs, k=4).collect())
    assert got == [(1, 37, 1, True), (3, 0, 3, True), (3, 37, 1, False), (3, 37, 1, False), (5, 37, 1, False)]


def test_near_duplicates_in_many_tiles(spark, monkeypatch):
    """A group of near copies, half of them too far from all others, dealt to small tiles; against all pairs."""
    import random

    for name, value in (("SETS", 7), ("SKETCHED", 9), ("SHINGLES", 1 << 10), ("HELD", 1 << 12), ("COUNTED", 1 << 8)):
        monkeypatch.setattr(neardup, name, value)
    rng = random.Random(5)
    base, rows = [f"b{i}" for i in range(80)], []
    for i in range(90):
        w = list(base)
        for j in rng.sample(range(80), rng.choice([1, 2, 3, 5, 6])):
            w[j] = f"x{i}_{j}"
        rows.append((1000 - i, " ".join(w)))
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    got = {r.doc_id: r.component_id for r in neardup.near_duplicates(docs, k=4).collect()}
    sets = {i: {tuple(t.split()[j : j + 4]) for j in range(77)} for i, t in rows}
    label = {i: i for i in sets}
    changed = True
    while changed:
        changed = False
        for a in sets:
            for b in sets:
                if label[a] != label[b] and 100 * len(sets[a] & sets[b]) >= 80 * len(sets[a] | sets[b]):
                    label[a] = label[b] = min(label[a], label[b])
                    changed = True
    assert got == label and len(set(label.values())) > 5


def test_texts_beyond_slices_and_batches(spark):
    """A text longer than a slice and than an Arrow batch, and one without any space, in the operators that read texts."""
    import hashlib

    words = [f"w{i % 9973}q{i % 101}" for i in range(700_000)]
    big = " ".join(words)
    assert len(big) > 5 << 20
    docs = spark.createDataFrame([(1, big), (2, big), (3, "x" * 3_000_000), (4, "a b"), (5, None)], "doc_id long, text string").cache()
    near = {r.doc_id: (r.component_id, r.kept) for r in neardup.near_duplicates(docs, k=4).collect()}
    assert near == {1: (1, True), 2: (1, False), 3: (3, True), 4: (4, True), 5: (5, True)}
    cut = {r.doc_id: (r.n_words, r.n_removed) for r in substring.dedup_substrings(docs, length=13).select("doc_id", "n_words", "n_removed").collect()}
    assert cut == {1: (700_000, 0), 2: (700_000, 700_000), 3: (1, 0), 4: (2, 0), 5: (0, 0)}
    coded = bytebpe.encode_decode(docs, P.path("byte_bpe_50k.tiktoken"), P.PATTERN).selectExpr("rest.doc_id", "decoded_sha256", "n_tokens").collect()
    assert {r.doc_id: r.decoded_sha256 for r in coded} == {i: hashlib.sha256(t.encode()).hexdigest() for i, t in ((1, big), (2, big), (3, "x" * 3_000_000), (4, "a b"), (5, ""))}
    files_ = tokenfiles.token_round_trip(docs, P.path("byte_bpe_50k.json"), 0).collect()
    assert {r.doc_id: r.n_tokens - 1 for r in files_} == {r.doc_id: r.n_tokens for r in coded}
    judged = {r.doc_id: r.n_words for r in hostrules.judge(docs.withColumn("host", F.lit("h"))).collect()}
    scored = {r.doc_id: r.n_tokens - 1 for r in ngram.score_texts(docs.withColumn("held_out", F.lit(False)), docs.select("text")).collect()}
    sized = {r.doc_id: r["size"] for r in mixture.repetition_plan(docs.withColumn("source", F.lit("s"))).collect()}
    assert judged == scored == sized == {1: 700_000, 2: 700_000, 3: 1, 4: 2, 5: 0}
    assert quality.featured(docs).count() == 5


def test_common_contexts_change_no_score(spark, tiny):
    from geoweave.llm import ngram as n

    docs = spark.read.parquet(f"{tiny}/documents.parquet").selectExpr("doc_id", "false as held_out", "text")
    found = []
    for fraction in (0.0, 1.0):
        model = n.train(docs.select("text"), 8, fraction)
        rows = docs.mapInArrow(n.scores(model), "doc_id long, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double")
        found.append((len(model.common), {r.doc_id: (r.n_known, round(r.score, 6)) for r in rows.collect()}, model.sums))
    assert found[0][0] == 0 and found[1][0] > 0 and found[0][1:] == found[1][1:]


def _host_rows(spark, hosts: dict) -> list:
    """Documents of hosts {name: (good, noisy, failing)}: clean ones, ones with half as many symbols as a rule allows, ones that fail it."""
    words = " ".join(f"word{i}" for i in range(40))
    kinds = (words, words + " # # #", words + " # # # # # #")
    rows = [(h, k, kinds[k]) for h, n in hosts.items() for k in range(3) for _ in range(n[k])]
    docs = spark.createDataFrame([(i, h, t) for i, (h, _, t) in enumerate(rows)], "doc_id long, host string, text string")
    return [(rows[r.doc_id][0], rows[r.doc_id][1], r) for r in hostrules.judge(docs).collect()]


def test_hosts_decide_over_documents(spark):
    """A suspect host loses documents that an ordinary one keeps, a trusted one keeps some that others lose; clean ones stay everywhere."""
    hosts = {f"h{i}": (90, 5, 5) for i in range(20)} | {"bad": (20, 10, 70), "good": (200, 0, 1)}
    judged = _host_rows(spark, hosts)
    assert {h: r.host_verdict for h, _, r in judged} == {f"h{i}": hostrules.ORDINARY for i in range(20)} | {"bad": hostrules.SUSPECT, "good": hostrules.ORDINARY}
    for h, kind, r in judged:
        assert r.kept == (kind == 0 or (kind == 1 and h != "bad"))
    hosts = {f"h{i}": (50, 0, 50) for i in range(10)} | {"good": (100, 0, 1)}
    for h, kind, r in _host_rows(spark, hosts):
        assert r.kept == (kind == 0 or h == "good") and r.host_verdict == (hostrules.TRUSTED if h == "good" else hostrules.ORDINARY)


def test_shrinking_turns_the_verdict_on_a_small_host(spark):
    """Two hosts with the same share of failures: the large one is suspect, the small one too near the prior to be."""
    hosts = {f"h{i}": (90, 0, 10 + i % 3) for i in range(30)} | {"large": (300, 30, 300), "small": (1, 1, 1)}
    verdict = {h: (r.host_verdict, r.host_rate) for h, _, r in _host_rows(spark, hosts)}
    assert verdict["large"][0] == hostrules.SUSPECT and verdict["small"][0] == hostrules.ORDINARY
    assert 0.1 < verdict["small"][1] < 1 / 3 and all(verdict[f"h{i}"][0] == hostrules.ORDINARY for i in range(30))
    alike = _host_rows(spark, {f"h{i}": (40, 5, 10) for i in range(8)})
    assert {r.host_verdict for *_, r in alike} == {hostrules.ORDINARY}


@pytest.mark.parametrize("order", [2, 3])
def test_a_lost_model_file_is_an_error(spark, order):
    import glob
    import os

    docs = spark.createDataFrame([(i, False, f"some words {i % 5} and others {i}") for i in range(40)], "doc_id long, held_out boolean, text string")
    model = (ngram.train(docs, buckets=3) if order == 2 else __import__("geoweave.llm.triples", fromlist=["train"]).train(docs, buckets=3))
    module = ngram if order == 2 else __import__("geoweave.llm.triples", fromlist=["scores"])
    put = sorted(f"{n.split('-')[0]}" for n in model.names)
    assert put == sorted(["words", "pairs"] * 3 + ["triples"] * (3 if order == 3 else 0))
    for path in glob.glob(f"{model.path.removeprefix('file://')}/pairs-*"):
        os.remove(path)
    schema = "doc_id long, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double"
    with pytest.raises(Exception, match="No such file"):
        docs.select("doc_id", "held_out", "text").mapInArrow(module.scores(model), schema).collect()
