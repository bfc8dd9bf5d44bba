"""The ten queries and the pipeline on the small folder: against SQL where it has them, else against plain versions."""

import base64
import binascii
import math
import re
import zlib
from collections import Counter, defaultdict
from hashlib import sha256

import numpy as np
import pyarrow.parquet as pq
import pytest
import public_tokenizers as P

from geoweave.llm.registry import ORACLES, QUERIES

WORD = re.compile(r"[^\x20\x09-\x0D]+")


@pytest.fixture(scope="module")
def docs(tiny):
    return pq.read_table(f"{tiny}/documents.parquet").to_pandas()


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_query_matches_sql(spark, sql, same, tiny, name):
    same(QUERIES[name](spark, tiny).toPandas(), sql(tiny, ORACLES[name]))


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_empty_tables_give_empty_results(spark, empty, name):
    assert QUERIES[name](spark, empty).count() == 0


def filled(sizes: dict, weights: dict, total: float) -> dict:
    """Targets by capping and resharing until none is above twice its size."""
    full: dict = {}
    while True:
        open_ = [s for s in sizes if s not in full]
        left = total - sum(full.values())
        share = {s: left * weights[s] / sum(weights[x] for x in open_) for s in open_}
        over = [s for s in open_ if share[s] > 2 * sizes[s]]
        if not over:
            return full | share
        full |= {s: 2.0 * sizes[s] for s in over}


def test_mix(spark, tiny, docs):
    got = QUERIES["op1_mix_sources"](spark, tiny).toPandas().set_index("doc_id")
    size = {i: len(WORD.findall(t or "")) for i, t in zip(docs.doc_id, docs.text)}
    of = dict(zip(docs.doc_id, docs.source))
    sizes: dict = defaultdict(int)
    for i, n in size.items():
        sizes[of[i]] += n
    names = sorted((s for s in sizes if s is not None)) + [None] * (None in sizes)
    target = filled(sizes, {s: (5, 2, 1)[i % 3] for i, s in enumerate(names)}, 1.5 * sum(sizes.values()))
    for i in size:
        row = got.loc[i]
        assert (row["size"], row.source_size) == (size[i], sizes[of[i]])
        assert math.isclose(row.target, target[of[i]], rel_tol=1e-9)
        assert row.taken in (size[i] * math.floor(row.target / row.source_size), size[i] * (math.floor(row.target / row.source_size) + 1)) and row.taken <= 2 * size[i]
    again = QUERIES["op1_mix_sources"](spark, tiny).toPandas().set_index("doc_id")
    assert (again.taken.sort_index() == got.taken.sort_index()).all()


def test_mix_draws_from_the_hash_of_the_id(spark):
    """copies is floor(rate), and one more where a number from the id's hash is below the fraction; words come near their target."""
    import random

    import xxhash

    from geoweave.llm.mixture import mix_sources, repetition_plan

    rng = random.Random(2)
    rows = [(i, " ".join(["w"] * rng.randint(1, 40)), "abc"[i % 7 % 3]) for i in range(4000)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string")
    plan = repetition_plan(docs).collect()
    taken, target, spread = Counter(), {}, Counter()
    for r in plan:
        rate = r.target / r.source_size
        draw = xxhash.xxh64_intdigest((20240).to_bytes(4, "little"), xxhash.xxh64_intdigest(r.doc_id.to_bytes(8, "little"), 42)) >> 11
        assert r.copies == math.floor(rate) + (draw / 2**53 < rate - math.floor(rate))
        taken[r.source] += r["size"] * r.copies
        target[r.source] = r.target
        spread[r.source] += r["size"] ** 2 * (rate % 1) * (1 - rate % 1)
    assert all(abs(taken[s] - target[s]) <= 4.5 * spread[s] ** 0.5 + 1e-6 for s in target)
    mixed = Counter(r.doc_id for r in mix_sources(docs).select("doc_id").collect())
    assert mixed == Counter({r.doc_id: r.copies for r in plan if r.copies})


def tiktoken_ids(texts):
    import tiktoken

    with open(P.path("byte_bpe_50k.tiktoken"), "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    coder = tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=ranks, special_tokens={})
    return [coder.encode_ordinary(t or "") for t in texts]


def test_byte_bpe(spark, tiny, docs):
    got = QUERIES["op9_byte_bpe"](spark, tiny).toPandas().set_index("doc_id")
    for i, t, ids in zip(docs.doc_id, docs.text, tiktoken_ids(docs.text)):
        row = got.loc[i]
        assert row.n_tokens == len(ids)
        assert row.ids_sha256 == sha256(" ".join(map(str, ids)).encode()).hexdigest()
        assert row.decoded_sha256 == sha256((t or "").encode()).hexdigest()


def test_token_files(spark, tiny, docs):
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(P.path("byte_bpe_50k.json"))
    got, start = QUERIES["op2_token_files"](spark, tiny).toPandas().set_index("doc_id"), 0
    for i, text in sorted(zip(docs.doc_id, docs.text)):
        ids = t.encode(text or "", add_special_tokens=False).ids + [0]
        assert tuple(got.loc[i][["start", "n_tokens", "ids_crc32"]]) == (start, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes()))
        start += len(ids)


def test_added_tokens_in_texts_are_tokens():
    """Ids of a slice of texts are those of plain calls where texts hold an added token, end with half of one, or begin with the rest."""
    from tokenizers import Tokenizer

    from geoweave.llm.tokenfiles import tokenizer

    t = Tokenizer.from_file(P.path("byte_bpe_50k.json"))
    texts = ["4567 <|endoftext|> a", "plain one", "", "<|endo", "ftext|>", "<|endoftext|>", "<|endoftext|><|endoftext|>x y", "a <|endoftext", "|> b"]
    raw = [x.encode() for x in texts]
    ids, first = tokenizer(P.path("byte_bpe_50k.json"))[0].ids(np.frombuffer(b"".join(raw), np.uint8), np.cumsum([0, *map(len, raw)]))
    assert 50256 in ids
    for i, text in enumerate(texts):
        assert ids[first[i] : first[i + 1]].tolist() == t.encode(text, add_special_tokens=False).ids


@pytest.mark.parametrize("bits", [1, 3, 8, 13, 16, 17, 31, 32])
@pytest.mark.parametrize("n", [0, 1, 7, 8, 9, 1000])
def test_packed_bits(bits, n):
    from geoweave.llm.tokenfiles import pack_bits, unpack_bits

    ids = np.random.default_rng(bits * 100 + n).integers(0, 2**bits, n, dtype=np.uint64).astype(np.uint32)
    packed = pack_bits(ids, bits)
    assert len(packed) == -(-n * bits // 8)
    assert (unpack_bits(packed, n, bits) == ids).all()


def test_language_model(spark, tiny, docs):
    low = str.maketrans({chr(c): chr(c + 32) for c in range(65, 91)})
    tokens = {i: WORD.findall((t or "").translate(low)) + ["\n"] for i, t in zip(docs.doc_id, docs.text)}
    held = {i: binascii.crc32(str(i).encode()) % 5 == 1 for i in tokens}
    pairs: Counter = Counter()
    for i, ts in tokens.items():
        if not held[i]:
            pairs.update(zip(["\t", *ts], ts))
    count, before, after, total = Counter(), Counter(), defaultdict(lambda: [0, 0, 0]), Counter()
    for (h, w), n in pairs.items():
        count[w] += n
        before[w] += 1
        after[h][min(n, 3) - 1] += 1
        total[h] += n

    def discount(values):
        n = [sum(v == k for v in values) for k in (1, 2, 3, 4)]
        y = n[0] / (n[0] + 2 * n[1]) if n[0] and n[1] else 0.5
        return [0.0] + [min(max((k - (k + 1) * y * n[k] / n[k - 1]) if n[k - 1] else y, 0.05), 0.95 * k) for k in (1, 2, 3)]

    d, e, v, all_ = discount(pairs.values()), discount(before.values()), len(count), sum(count.values())
    rest = sum(e[min(n, 3)] for n in before.values())

    def q(w):
        return (max(before[w] - e[min(before[w], 3)], 0) + rest / (v + 1)) / len(pairs)

    def p(h, w):
        if not total[h]:
            return q(w)
        n = pairs[h, w]
        return (max(n - d[min(n, 3)], 0) + sum(d[k + 1] * after[h][k] for k in range(3)) * q(w)) / total[h]

    assert math.isclose(sum(map(q, count)) + rest / (v + 1) / len(pairs), 1, rel_tol=1e-9)
    h = max(total, key=total.get)
    assert math.isclose(sum(p(h, w) for w in count) + p(h, "never seen"), 1, rel_tol=1e-9)
    got = QUERIES["op6_lm_scores"](spark, tiny).toPandas().set_index("doc_id")
    for i, ts in tokens.items():
        row = got.loc[i]
        assert (row.held_out, row.n_tokens, row.n_known, row.train_tokens) == (held[i], len(ts), sum(count[w] > 0 for w in ts), all_)
        assert math.isclose(row.base_score, sum(math.log10((count[w] + 0.5) / (all_ + 0.5 * (v + 1))) for w in ts), rel_tol=1e-9)
        assert math.isclose(row.score, sum(math.log10(p(a, b)) for a, b in zip(["\t", *ts], ts)), rel_tol=1e-9)


def test_language_model_of_order_three(spark, tiny, docs):
    low = str.maketrans({chr(c): chr(c + 32) for c in range(65, 91)})
    tokens = {i: WORD.findall((t or "").translate(low)) + ["\n"] for i, t in zip(docs.doc_id, docs.text)}
    held = {i: binascii.crc32(str(i).encode()) % 5 == 1 for i in tokens}
    triples: Counter = Counter()
    for i, ts in tokens.items():
        if not held[i]:
            triples.update(zip(["\t", "\t", *ts], ["\t", *ts], ts))
    pairs = Counter((v, w) for _, v, w in triples)
    before, count = Counter(w for _, w in pairs), Counter()
    for (_, _, w), n in triples.items():
        count[w] += n

    def discount(values):
        n = [sum(v == k for v in values) for k in (1, 2, 3, 4)]
        y = n[0] / (n[0] + 2 * n[1]) if n[0] and n[1] else 0.5
        return [0.0] + [min(max((k - (k + 1) * y * n[k] / n[k - 1]) if n[k - 1] else y, 0.05), 0.95 * k) for k in (1, 2, 3)]

    def level(table):
        d, total, lost = discount(table.values()), Counter(), Counter()
        for key, n in table.items():
            total[key[:-1]] += n
            lost[key[:-1]] += d[min(n, 3)]
        return lambda key, under: (max(table[key] - d[min(table[key], 3)], 0) + lost[key[:-1]] * under) / total[key[:-1]] if total[key[:-1]] else under

    v, all_, three, two = len(count), sum(count.values()), level(triples), level(pairs)
    one = level(Counter({(w,): n for w, n in before.items()}))

    def p(a, b, w):
        return three((a, b, w), two((b, w), one((w,), 1 / (v + 1))))

    a, b, _ = triples.most_common(1)[0][0]
    assert math.isclose(sum(p(a, b, w) for w in count) + p(a, b, "never seen"), 1, rel_tol=1e-9)
    got = QUERIES["op6_lm_scores_order3"](spark, tiny).toPandas().set_index("doc_id")
    assert sorted(got.index) == sorted(tokens)
    for i, ts in tokens.items():
        row = got.loc[i]
        assert (row.held_out, row.n_tokens, row.n_known, row.train_tokens) == (held[i], len(ts), sum(count[w] > 0 for w in ts), all_)
        assert math.isclose(row.base_score, sum(math.log10((count[w] + 0.5) / (all_ + 0.5 * (v + 1))) for w in ts), rel_tol=1e-9)
        assert math.isclose(row.score, sum(math.log10(p(*x)) for x in zip(["\t", "\t", *ts], ["\t", *ts], ts)), rel_tol=1e-9)


def test_counts_over_254_have_a_file_of_their_own(spark):
    from geoweave.llm.ngram import train
    from geoweave.llm import text as tx

    model = train(spark.createDataFrame([("a b " * 1000,), ("a b",)], "text string"), 2)
    w = tx.Words(np.frombuffer(b"a b", np.uint8), np.array([0, 3]))
    assert model.pairs(w.hash[:1], w.hash[1:]).tolist() == [1001]


def test_quality_on_held_out_labels(spark):
    folder = "/root/testdata/sf0.01"
    got = QUERIES["op5_pu_quality"](spark, folder).toPandas()
    labels = pq.read_table(f"{folder}/labels.parquet").to_pandas()
    assert got.score.between(0, 1).all() and (got.predicted == (got.score >= 0.7)).all()
    held = got[got.held_out].merge(labels, on="doc_id")
    assert (held.predicted == held.quality).mean() > 0.95


def test_quality_scores_every_text(spark, tiny, docs):
    got = QUERIES["op5_pu_quality"](spark, tiny).toPandas()
    assert sorted(got.doc_id) == sorted(docs.doc_id) and got.score.notna().all()


def test_pipeline(spark, sql, tiny, docs):
    import corpus_pipeline as cp

    at, kept = spark.read.parquet(f"{tiny}/documents.parquet"), {}
    for name, stage in cp.STAGES:
        at = stage(spark, at, tiny)
        at = spark.createDataFrame(at.toArrow()) if at.count() else at
        kept[name] = at.toPandas()
        if name != cp.STAGES[-1][0]:
            assert at.columns == cp.COLUMNS
    passed = sql(tiny, ORACLES["op8_host_rules"])
    assert sorted(kept["quality rules"].doc_id) == sorted(passed[passed.kept].doc_id)
    rows = kept["quality rules"].sort_values("doc_id")
    low = str.maketrans({chr(c): chr(c + 32) for c in range(65, 91)})
    words = {i: WORD.findall(t.translate(low)) for i, t in zip(rows.doc_id, rows.text)}
    sets = {i: {tuple(w[j : j + 5]) for j in range(len(w) - 4)} for i, w in words.items()}
    links = [(a, b) for a in sets for b in sets if a < b and 100 * len(sets[a] & sets[b]) >= 80 * len(sets[a] | sets[b])]
    label = {i: i for i in sets}
    for _ in sets:
        for a, b in links:
            label[a] = label[b] = min(label[a], label[b])
    assert sorted(kept["near-duplicates"].doc_id) == sorted(i for i in label if label[i] == i)
    rows, seen, want = kept["near-duplicates"].sort_values("doc_id"), set(), {}
    for i, t in zip(rows.doc_id, rows.text):
        w = WORD.findall(t)
        grams = [tuple(w[j : j + 50]) for j in range(len(w) - 49)]
        gone = {j + k for j, x in enumerate(grams) if x in seen for k in range(50)}
        want[i] = [x for j, x in enumerate(w) if j not in gone]
        seen |= set(grams)
    rows = kept["substring dedup"]
    assert {i: WORD.findall(t or "") for i, t in zip(rows.doc_id, rows.text)} == want
    assert any(len(WORD.findall(t)) != len(want[i]) for i, t in zip(kept["near-duplicates"].doc_id, kept["near-duplicates"].text))
    mixed, last = kept["mixing sources"], kept["byte-level BPE"]
    assert set(mixed.doc_id) <= set(rows.doc_id) and mixed.doc_id.value_counts().max() <= 2
    assert Counter(last.doc_id) == Counter(mixed.doc_id)
    ids = dict(zip(mixed.doc_id, tiktoken_ids(mixed.text)))
    assert all(list(x) == ids[i] for i, x in zip(last.doc_id, last.token_ids))

def test_stages_keep_empty_texts_apart_and_documents_together(spark, tiny):
    import corpus_pipeline as cp

    long = " ".join(f"word{i}" for i in range(60))
    other = " ".join(f"other{i}" for i in range(60))
    rows = [(1, long), (2, ""), (3, None), (4, "lead " + long), (5, long + "\n" + other), (6, other), (6, "one more")]
    docs = spark.createDataFrame([(i, t, "en", "s", 0) for i, t in rows], "doc_id long, text string, lang string, source string, n_chars long").withColumn("rest", cp.F.lit(1))
    cut = {(r.doc_id, r.text) for r in cp.substring_dedup(spark, docs, tiny).collect()}
    assert cut == {(1, long), (2, ""), (3, None), (4, "lead"), (5, other), (6, ""), (6, "one more")}
    two = spark.createDataFrame([(i, t, "en", "s", 0) for i, t in [(1, long), (3, long), (3, other), (5, other), (7, ""), (8, None)]], docs.drop("rest").schema)
    kept = sorted(((r.doc_id, r.text) for r in cp.near_dedup(spark, two, tiny).collect()), key=str)
    assert kept == sorted([(1, long), (7, ""), (8, None)], key=str)
    for name, stage in cp.STAGES:
        assert stage(spark, docs.limit(0), tiny).count() == 0, name
