from __future__ import annotations

import hashlib
import heapq
import io
import random
import zlib

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from quillstream.llm import bpe, components, exact_dedup, lm, media, mixing, pii, sharding, simhash, suffix_dedup, toxicity
from quillstream.llm.suffix_array import COVERS, sort_suffixes
from tests.llm import brute

random.seed(11)
VOCABULARY = ["alpha", "beta", "Gamma", "delta", "épsilon", "zeta,", "eta.", "theta", "iota", "kappa"]


def prose(n: int) -> str:
    return " ".join(random.choice(VOCABULARY) + (random.choice("abcdefgh") if random.random() < 0.4 else "") for _ in range(n))


SHARED = prose(40)
LONG = prose(30_000)
#: Copies, near copies, shared passages, empty and null texts, spaces only, long texts, null ids and sources, repeated rows.
ROWS = [
    *[(i, prose(random.randint(1, 60)), f"s{i % 4}") for i in range(60)],
    *[(100 + i, SHARED, "hot") for i in range(12)],
    *[(200 + i, prose(10) + " " + SHARED + " " + prose(7), "s1") for i in range(8)],
    *[(300 + i, SHARED.replace("alpha", "alphx", 1) + " " * i, "s2") for i in range(3)],
    (400, None, "s0"), (401, "", None), (402, " \t\n ", None), (403, LONG, "s3"), (404, LONG + " tail", "s3"), (405, "a" * 500, "s1"), (406, "b" + "a" * 300, "s1"), (407, "Word", "s9"), (407, "Word", "s9"), (None, "no id at all", "s0"), (409, "x\x00y" * 40, "s0"), (410, "日本語の文章です。" * 12, "s1"),
]
SCHEMA = "doc_id long, text string, source string, t string, h string, part int, key string"


@pytest.fixture(scope="module")
def docs(spark):
    """With columns whose names operators use inside."""
    return spark.createDataFrame([(i, t, s, "x", None, 7, "k") for i, t, s in ROWS], SCHEMA).repartition(3)


@pytest.fixture(scope="module")
def none(spark):
    return spark.createDataFrame([], SCHEMA)


def rows_of(df):
    return sorted((tuple(r) for r in df.collect()), key=repr)


# 1


def test_simhash(docs):
    fps = {(i, t): brute.fingerprint(t) for i, t, _ in ROWS}
    ids = brute.groups((f, i) for (i, _), f in fps.items() if i is not None)
    comp = brute.components({f: f for f in fps.values()}, lambda a, b: (a ^ b).bit_count() <= 2)
    least = {}
    for f, c in comp.items():
        least[c] = min([least.get(c, 1 << 60), *ids.get(f, [])])
    want = sorted(((i, f"{fps[i, t]:016x}", least[comp[fps[i, t]]] if least[comp[fps[i, t]]] < 1 << 60 else None) for i, t, _ in ROWS), key=repr)
    assert rows_of(simhash.simhash_components(docs).select("doc_id", "fingerprint", "component_id")) == want


@pytest.mark.parametrize("seed", range(3))
def test_links_of_crowds(spark, seed):
    """Clusters up to hundreds of fingerprints a few bits apart, chains, and strangers."""
    r = random.Random(seed)
    fps = set()
    for size in (1, 2, 3, 5, 150):
        centre = r.getrandbits(64)
        for _ in range(size):
            x = centre
            for _ in range(r.choice((0, 1, 2, 2, 3, 4))):
                x ^= 1 << r.randrange(64)
            fps.add(x)
    chain = r.getrandbits(64)
    for k in range(0, 40, 2):
        fps.add(chain)
        chain ^= 3 << k
    signed = {x - (1 << 64) if x >> 63 else x for x in fps}
    want = brute.components({x: x for x in signed}, lambda a, b: ((a ^ b) & (1 << 64) - 1).bit_count() <= 2)
    got = {x.node: x.component for x in components.connected_components(simhash.links(spark.createDataFrame([(x,) for x in signed], "fp long"))).collect()}
    assert {x: got.get(x, x) for x in signed} == want


def test_one_row_per_component(spark, docs):
    """Null and repeated ids: exactly one row of each component."""
    w = prose(50)
    rows = [(5, w), (None, w + " "), (None, "another text"), (None, "another text"), (7, "x"), (7, "y"), (7, "y"), (3, None), (9, ""), (None, None)]
    rows += [(None, f"{prose(8)} {k}") for k in range(300)]
    for df in (spark.createDataFrame([(i, t, None, 1) for i, t in rows], "doc_id long, text string, fp string, x int"), docs):
        fps = [(r.doc_id, r.text, brute.fingerprint(r.text)) for r in df.collect()]
        comp = brute.components({f: f for _, _, f in fps}, lambda a, b: (a ^ b).bit_count() <= 2)
        least = {}
        for i, _, f in fps:
            k = 1 << 62 if i is None else i
            least[comp[f]] = min(least.get(comp[f], 1 << 62), k)
        out = simhash.keep_one_per_component(df)
        got = {comp[brute.fingerprint(r.text)]: 1 << 62 if r.doc_id is None else r.doc_id for r in out.collect()}
        assert out.columns == df.columns and out.count() == len(least) and got == least


def test_components_of_a_hub_and_a_path(spark):
    edges = [(0, k) for k in range(1, 300)] + [(1000 + k, 1001 + k) for k in range(50)] + [(5, 5)]
    got = {r.node: r.component for r in components.connected_components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {k: 0 for k in range(300)} | {1000 + k: 1000 for k in range(51)}


# 2


@pytest.mark.parametrize("hash_fn", [exact_dedup.content_hash, lambda t: F.lit(b"same"), lambda t: F.unhex(F.substring(F.md5(t), 1, 2))])
def test_exact_dedup(docs, hash_fn):
    """Also with hashes that collide."""
    same = brute.groups((t or "", i) for i, t, _ in ROWS)
    got = exact_dedup.exact_dedup(docs, hash_fn=hash_fn).collect()
    assert len(got) == len(ROWS)
    for r in got:
        ids = next(v for t, v in same.items() if hashlib.sha256(t.encode()).hexdigest() == r.text_sha256)
        known = [i for i in ids if i is not None]
        assert (r.keep_id, r.group_size) == (max(known, default=None), len(ids))
    assert sum(r.kept for r in got) == len(same) and all(r.doc_id == r.keep_id for r in got if r.kept)


def test_one_row_per_text(docs):
    got = exact_dedup.keep_one_per_text(docs)
    assert got.columns == docs.columns
    best = {}
    for i, t, _ in ROWS:
        k = t or ""
        best[k] = max(best.get(k, -1), -1 if i is None else i)
    assert sorted(-1 if r.doc_id is None else r.doc_id for r in got.collect()) == sorted(best.values())


# 3


def test_sharding(docs):
    got = sharding.shard_rows(docs, 4).collect()
    text = {i: t for i, t, _ in ROWS}
    assert len(got) == len(ROWS)
    for r in got:
        raw = (text[r.doc_id] or "").encode()
        assert (r.size, r.text_crc32, r.law, r.grown_shard) == (len(raw) + 1, zlib.crc32(raw), "bytes", None)
    for slots in brute.groups((r.shard, r.slot) for r in got).values():
        assert sorted(slots) == list(range(len(slots)))
    assert all(len(set(s)) == 1 for s in brute.groups((text[r.doc_id] or "", r.shard) for r in got).values())


@pytest.mark.parametrize("seed", range(6))
def test_schedule_is_lpt(seed):
    """Against a heap that takes groups one by one; with classes of many groups."""
    r = random.Random(seed)
    classes = {r.randint(1, 60): r.choice((1, 2, 5, 40, 900)) for _ in range(r.randint(1, 30))}
    heap = [(0, s) for s in range(7)]
    for size in sorted(classes, reverse=True):
        for _ in range(classes[size]):
            x, s = heap[0]
            heapq.heapreplace(heap, (x + size, s))
    load = [0] * 7
    for size, given in sharding.schedule(classes.items(), 7):
        assert sum(given) == classes[size]
        load = [x + size * k for x, k in zip(load, given)]
    assert sorted((x, s) for s, x in enumerate(load)) == sorted(heap)
    assert sharding.schedule([], 3) == []


def test_shards_are_those_of_lpt(docs, spark):
    """Loads as by brute force, also where thousands of groups share a size."""
    for df in (docs.select("doc_id", "text"), spark.createDataFrame([(i, f"text {i % 1500}") for i in range(2000)], "doc_id long, text string")):
        size = {}
        for r in df.collect():
            size[r.text or ""] = size.get(r.text or "", 0) + len((r.text or "").encode()) + 1
        load = [0] * 4
        for x in sorted(size.values(), reverse=True):
            load[load.index(min(load))] += x
        got = {r["shard"]: r["sum(size)"] for r in sharding.shard_rows(df, 4).groupBy("shard").sum("size").collect()}
        assert [got.get(s, 0) for s in range(4)] == load


# 4


@pytest.mark.parametrize("shape", [(1, 1, 3), (5, 7, 3), (8, 64, 3)])
def test_images_round_trip(shape):
    img = np.random.default_rng(1).integers(0, 256, shape, np.uint8)
    assert (media.decode(media.encode_ppm(img)) == img).all() and (media.decode(media.encode_bmp(img)) == img).all()
    assert (media.decode(media.encode_ppm(img[:, :, 0])) == img[:, :, 0]).all()


def test_netpbm_kinds():
    assert media.decode(b"P1 # c\n2 2\n1 0\n0 1\n").tolist() == [[0, 255], [255, 0]]
    assert media.decode(b"P2\n2 1\n15\n0 15\n").tolist() == [[0, 255]]
    assert media.decode(b"P3\n1 1\n255\n1 2 3\n").tolist() == [[[1, 2, 3]]]
    assert media.decode(b"P4\n9 1\n\x80\x80").tolist() == [[0, 255, 255, 255, 255, 255, 255, 255, 0]]
    with pytest.raises(ValueError):
        media.decode(b"P6\n9 9\n255\nxx")


def test_area_resize():
    a = np.arange(24, dtype=np.float64).reshape(4, 6)
    assert np.allclose(media.area_resize(a, 2, 3), a.reshape(2, 2, 3, 2).mean((1, 3)))
    assert np.allclose(media.area_resize(a, 3, 5).mean(), a.mean()) and np.allclose(media.area_resize(a, 8, 12)[::2, ::2], a)


def test_media_rows(docs, spark):
    text = brute.groups((i, t) for i, t, _ in ROWS)
    for r in media.media_features(docs).collect():
        raw = (text[r.doc_id][0] or "").encode()
        full = raw.ljust(max(1, -(-len(raw) // 192)) * 192)
        assert (r.n_bytes, r.payload_bytes, r.payload_sha256, r.tail_crc32) == (len(raw), len(full), hashlib.sha256(full).hexdigest(), zlib.crc32(full[-16:]))
        assert r.media_sha256 == hashlib.sha256(media.store(full)).hexdigest() and len(r.feature) == 16
    got = media.image_tiles(spark.createDataFrame([("a", media.encode_bmp(np.zeros((3, 2, 3), np.uint8))), ("b", b"junk"), ("c", None)], "id string, content binary")).collect()
    assert [(r.width, r.height, r.tile is not None) for r in got] == [(2, 3, True), (None, None, False), (None, None, False)]


# 5


def test_toxicity(spark):
    bad = ["vile" + x for x in ("ness", "r", "", "st")]
    docs, labels = [], []
    for i in range(600):
        toxic = i % 4 == 0
        w = prose(60).split()
        for _ in range(4 if toxic else 0):
            w.insert(random.randrange(60), random.choice(bad))
        docs.append((i, " ".join(w)))
        labels.append((i, int(toxic)))
    docs += [(1000, None), (1001, ""), (None, "vileness"), (1002, LONG), (1000, None)]
    df = spark.createDataFrame(docs, "doc_id long, text string")
    lab = spark.createDataFrame([*labels, (5, None), (None, 1)], "doc_id long, toxic int")
    model = toxicity.learn(df, lab)
    got = toxicity.score_rows(df, model).collect()
    assert len(got) == len(docs) and all(0 <= r.score <= 1 and r.predicted == (r.score >= 0.3) for r in got)
    held = [r for r in got if r.held_out and r.doc_id is not None and r.doc_id < 600]
    assert held and np.mean([r.predicted == (r.doc_id % 4 == 0) for r in held]) > 0.95
    assert all(r.held_out == (brute.crc(r.doc_id) % 4 == 2) for r in got)
    kept = toxicity.keep_ordinary(df, model)
    assert kept.columns == df.columns and kept.count() == sum(not r.predicted for r in got)
    # held-out labels have no part in the model
    flipped = lab.withColumn("toxic", F.when(F.crc32(F.col("doc_id").cast("string")) % 4 == 2, 1 - F.col("toxic")).otherwise(F.col("toxic")))
    assert (toxicity.learn(df, flipped).weights == model.weights).all()


def test_toxicity_without_a_class(spark):
    df = spark.createDataFrame([(1, "a")], "doc_id long, text string")
    for label, score in ((0, 0.0), (1, 1.0)):
        assert toxicity.score_rows(df, toxicity.learn(df, spark.createDataFrame([(1, label)], "doc_id long, toxic int"))).first()["score"] == score
    assert toxicity.score_rows(df, toxicity.learn(df, spark.createDataFrame([], "doc_id long, toxic int"))).first()["score"] == 0.0


# 6


@pytest.mark.parametrize("v", sorted(COVERS))
def test_suffixes(v):
    r = random.Random(v)
    for _ in range(60):
        b = bytes(r.randrange(r.choice((1, 2, 3, 256))) for _ in range(r.randint(1, 200)))
        b = b[:15] * 7 if r.random() < 0.3 else b
        assert sort_suffixes(np.frombuffer(b, np.uint8), None, v, r.choice((4, 64, 4096))).tolist() == sorted(range(len(b)), key=lambda i: b[i:])


@pytest.mark.parametrize("frequent", [False, True])
def test_suffix_dedup(docs, monkeypatch, frequent):
    """frequent: every anchor of some documents is dealt window by window."""
    if frequent:
        anchors = suffix_dedup.blocks_of([SHARED.encode(), LONG[:5000].encode()], np.zeros(0, np.uint64))[0]
        monkeypatch.setattr(suffix_dedup, "frequent_anchors", lambda texts: np.unique(anchors))
    big = (1 << 63) - 1
    want = brute.removed([(big if i is None else i, t) for i, t, _ in ROWS])
    got = suffix_dedup.remove_repeats(docs).collect()
    assert len(got) == len(ROWS)
    for r in got:
        assert (r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) == want[big if r.doc_id is None else r.doc_id]


def test_suffix_dedup_at_every_edge(spark):
    """Passages around the window's length, at all offsets, in three documents; and pieces cut inside."""
    r = random.Random(5)
    noise = lambda n: "".join(r.choice("abcdefghijklmnop ") for _ in range(n))
    rows = []
    for k in range(30):
        p = noise(45 + k % 12)
        rows += [(3 * k + j, noise(r.randint(0, 60)) + p + noise(r.randint(0, 60))) for j in range(3)]
    got = {x.doc_id: x for x in suffix_dedup.remove_repeats(spark.createDataFrame(rows, "doc_id long, text string"), parts=3).collect()}
    assert {i: (x.n_bytes, x.n_removed, x.n_spans, x.kept_sha256) for i, x in got.items()} == brute.removed(rows)


def test_suffix_dedup_of_many_null_and_repeated_ids(spark):
    """Hundreds of rows without an id, and rows of one id with different texts."""
    r = random.Random(6)
    noise = lambda n: "".join(r.choice("abcdefghijklmnop ") for _ in range(n))
    shared = [noise(80) for _ in range(4)]
    some = lambda: noise(r.randint(0, 60)) + r.choice([*shared, ""]) + noise(r.randint(0, 60))
    rows = [(k, some()) for k in range(5)] + [(None, some()) for _ in range(400)] + [(7, some()) for _ in range(60)]
    big = (1 << 63) - 1
    want = brute.removed_rows([(big if i is None else i, t) for i, t in rows])
    got = suffix_dedup.remove_repeats(spark.createDataFrame(rows, "doc_id long, text string"), parts=3)
    assert rows_of(got.select("doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256")) == sorted(((i, *w) for (i, _), w in zip(rows, want)), key=repr)


def test_suffix_dedup_where_words_recur(spark):
    """Blocks under one anchor that share less than a window, just a window, or have their anchor twice."""
    r = random.Random(8)
    few = [bytes(r.choice(b"abcdefgh") for _ in range(r.randint(2, 6))).decode() for _ in range(12)]
    rows = [(k, " ".join(r.choices(few, k=r.randint(0, 120))) + r.choice(("", "ab" * r.randint(10, 60)))) for k in range(150)]
    got = {x.doc_id: x for x in suffix_dedup.remove_repeats(spark.createDataFrame(rows, "doc_id long, text string"), parts=3).collect()}
    assert {i: (x.n_bytes, x.n_removed, x.n_spans, x.kept_sha256) for i, x in got.items()} == brute.removed(rows)


def test_blocks_without_a_common_side_stay_closed():
    """A shared string shorter than a side puts no block's bytes on the way; one of a window's length does."""
    r = random.Random(9)
    noise = lambda n: bytes(r.randrange(97, 123) for _ in range(n))
    for shared, some in ((35, False), (50, True)):
        p = noise(shared)
        texts = [noise(200) + p + noise(200) for _ in range(20)]
        ids, keys = np.arange(20), suffix_dedup._text_keys(texts, False)
        anchor, h, doc, start, width, side = suffix_dedup.blocks_and_sides(texts, np.zeros(0, np.uint64))
        message = suffix_dedup.pack(ids, keys, doc, start, width, anchor, h, side)
        out = [x for b in suffix_dedup.resolve_blocks(1)(iter([suffix_dedup._batch([(0, suffix_dedup.BLOCKS, message)])])) for x in b.to_pylist()]
        assert any(x["kind"] == suffix_dedup.OPEN for x in out) == some


def test_blocks_are_held_a_few_texts_at_a_time(monkeypatch):
    monkeypatch.setattr(suffix_dedup, "HELD", 1000)
    texts = ["x" * 400] * 7 + ["", "y" * 5000, "z"]
    batch = pa.RecordBatch.from_arrays([pa.array(range(10)), pa.array(texts)], ["id", "text"])
    got = [(ids.tolist(), [t.decode() for t in part]) for ids, part in suffix_dedup._slices(iter([batch]))]
    assert [len(t) for _, t in got] == [3, 3, 3, 1] and sum((i for i, _ in got), []) == list(range(10)) and sum((t for _, t in got), []) == texts


def test_packed_blocks_come_back():
    """Without keys, and with some; short and long steps."""
    r = np.random.default_rng(3)
    doc = np.repeat([4, 0, 2], [3, 1, 5])
    for far in (100, 1 << 30):
        for keyed in (False, True):
            ids, keys = np.arange(5) * 7, suffix_dedup._text_keys([b"%d" % k for k in range(5)], keyed)
            start, width, h = np.sort(r.integers(0, far, 9)), r.integers(1, 65, 9), r.integers(0, 1 << 63, 9).astype(np.uint64)
            back, again, (d, s, w, x), end = suffix_dedup.unpack(data := suffix_dedup.pack(ids, keys, doc, start, width, h), (suffix_dedup.HASH,))
            assert end == len(data) and back[d].tolist() == ids[doc].tolist() and again[d].tolist() == keys[doc].tolist()
            assert (s.tolist(), w.tolist(), x.tolist()) == (start.tolist(), width.tolist(), h.tolist())


def test_long_texts_are_cut_into_pieces(monkeypatch):
    monkeypatch.setattr(suffix_dedup, "PIECE", 128)
    t = prose(200).encode()
    anchor, h, doc, start, width = suffix_dedup.blocks_of([b"short", t, t[:50]], np.zeros(0, np.uint64))
    seen = [s for d, a, w in zip(doc, start, width) if d == 1 for s in range(a, a + w)]
    assert sorted(seen) == list(range(len(t) - 49)) and [int(w) for d, w in zip(doc, width) if d == 2] == [1]


# 7


def test_mixing(docs, spark):
    sizes = {}
    for i, t, s in ROWS:
        sizes[s] = sizes.get(s, 0) + len(brute.words(t))
    want = brute.targets(sizes)
    got = mixing.mix(docs).collect()
    source = brute.groups(((i, t), s) for i, t, s in ROWS)
    assert len(got) == len(ROWS)
    taken, meant = {}, {}
    of = {i: s for i, _, s in ROWS}
    for r in got:
        s = of[r.doc_id]
        assert r.source_size == sizes[s] and 0 <= r.taken <= 2 * r.size
        taken[s], meant[s] = taken.get(s, 0) + r.taken, r.target
    for s in sizes:
        assert meant[s] == pytest.approx(want[s]) and abs(taken[s] - want[s]) <= 0.5
    assert source and rows_of(mixing.mix(docs)) == rows_of(mixing.mix(docs.repartition(5)))


def test_mixing_of_null_and_repeated_ids(spark):
    rows = [(None, prose(1 + k % 9), "s0") for k in range(400)] + [(7, prose(1 + k % 9), "s1") for k in range(90)] + [(8, "", "s1"), (9, None, None)]
    df = spark.createDataFrame(rows, "doc_id long, text string, source string")
    sizes = {s: sum(len(brute.words(t)) for _, t, x in rows if x == s) for s in ("s0", "s1", None)}
    want = brute.targets(sizes)
    got = mixing.mix(df).collect()
    assert len(got) == len(rows) and len({r.key for r in got}) > 300
    assert sum(r.taken for r in got) == pytest.approx(sum(want.values()), abs=2)
    took = mixing.repeated(df)
    assert took.columns == df.columns
    words = {s: sum(len(brute.words(r.text)) for r in took.collect() if r.source == s) for s in sizes}
    assert all(abs(words[s] - want[s]) <= 9 for s in sizes)


def test_water_filling(spark):
    r = random.Random(2)
    for _ in range(5):
        sizes = {f"s{k:02d}": r.choice((0, 1, 5, 100, 10_000)) for k in range(r.randint(1, 9))}
        got = {x.source: x.target for x in mixing.water_fill(spark.createDataFrame(list(sizes.items()), "source string, size long")).collect()}
        assert got == pytest.approx(brute.targets(sizes))


# 8

PII_TEXTS = [
    "mail a.b+c@x-y.co.uk, d@e.f_g@h.i and a@b.c_d@e.f", "ip 1.2.3.4.5 999.1.1.1 01.02.003.255 1.2.3", "card 4111 1111 1111 1111 or 4111-1111-1111-1112, 4111  1111 1111 1111, 41111111111111111111111", "call +1 (415) 555-1234. +44 20 7946 0958- +1234567", "é€😀 a@b.c 日 +1 415 555 1234",
    None, "", "@@@ +++ ...", "1 " * 4000, "9" * 5000, "x" * 20000 + "@y.z", "4" + "-1" * 15, "IBAN GB82 WEST 1234 5698 7654 32 and GB82 WEST 1234 5698 7654 33", "my ssn: 123-45-6789 but 123-45-6789", "0000.0000.0000.00000001 1.2.3.4@5.6",
]


def test_pii(spark):
    df = spark.createDataFrame(list(enumerate(PII_TEXTS)), "doc_id long, text string")
    for r in pii.find_pii(df).collect():
        want = brute.pii(PII_TEXTS[r.doc_id])
        base = ",".join(f"{k}:{a}:{b}" for k, a, b in want)
        assert r.base_sha256 == hashlib.sha256(base.encode()).hexdigest(), (PII_TEXTS[r.doc_id][:60], base, r.spans)
        assert [r.n_email, r.n_ip, r.n_card, r.n_phone] == [sum(k == x for k, _, _ in want) for x in ("email", "ip", "card", "phone")]
        assert set(filter(None, base.split(","))) <= set(r.spans.split(","))


def test_pii_validators_and_context(spark):
    got = {r.doc_id: r for r in pii.find_pii(spark.createDataFrame(list(enumerate(PII_TEXTS)), "doc_id long, text string")).collect()}
    assert got[12].spans == "iban:5:32"
    assert got[13].spans.split(",")[0] == "ssn:8:19" and got[3].scores.split(",")[0] == "0.90"


@pytest.mark.parametrize("seed", range(4))
def test_pii_on_noise(spark, seed):
    r = random.Random(seed)
    rows = [(i, "".join(r.choice(["1", "22", "4111111111111111", ".", "-", " ", "@", "+", "a", "b.c", "_", "(", ")", "255", "é"]) for _ in range(r.randint(1, 40)))) for i in range(150)]
    for x in pii.find_pii(spark.createDataFrame(rows, "doc_id long, text string")).collect():
        base = ",".join(f"{k}:{a}:{b}" for k, a, b in brute.pii(rows[x.doc_id][1]))
        assert x.base_sha256 == hashlib.sha256(base.encode()).hexdigest(), rows[x.doc_id][1]


IBAN = "GB82 WEST 1234 5698 7654 32"
HARD = [f"{IBAN} The rest", f"iban {IBAN} OK", f"_{IBAN}", f"{IBAN}7", f"x{IBAN}", f"DE89370400440532013000,{IBAN}", "ssn a123-45-6789", "_123-45-6789 ssn", "12-123-45-6789-0 ssn", "123-45-6789 is my ssn", "social 123-45-6789123-45-6789", "ssn 123-45-6789, 123-45-6789"]


def test_pii_equals_its_sql(spark):
    import duckdb
    import pandas as pd

    rows = [*enumerate(PII_TEXTS + HARD)]
    con = duckdb.connect()
    con.register("documents", pd.DataFrame(rows, columns=["doc_id", "text"]))
    want = con.sql(pii.oracle_sql())
    got = pii.find_pii(spark.createDataFrame(rows, "doc_id long, text string")).select(*want.columns)
    assert sorted(map(tuple, got.collect())) == sorted(want.fetchall())
    spans = {r.doc_id - len(PII_TEXTS): r.spans for r in got.collect()}
    assert [spans[0], spans[1], spans[6], spans[9]] == ["iban:0:27", "iban:5:32", "", "ssn:0:11"]


def test_pii_many_matches_in_a_text(spark):
    n = 20_000
    df = spark.createDataFrame([(1, "ab@c.de é " * n + "1.2.3.4 " * n)], "doc_id long, text string")
    (r,) = pii.find_pii(df).collect()
    want = [f"email:{10 * k}:{10 * k + 7}" for k in range(n)] + [f"ip:{10 * n + 8 * k}:{10 * n + 8 * k + 7}" for k in range(n)]
    assert r.spans == ",".join(want) and (r.n_email, r.n_ip) == (n, n)


# 9


@pytest.fixture(scope="module")
def tokenizer():
    pytest.importorskip("public_tokenizers")
    from tokenizers import Tokenizer

    return Tokenizer.from_file(bpe.default_path())


def test_bpe(docs, tokenizer):
    text = brute.groups((i, t) for i, t, _ in ROWS)
    got = bpe.bpe_rows(docs).collect()
    assert len(got) == len(ROWS)
    for r in got:
        t = text[r.doc_id][0] or ""
        ids = tokenizer.encode(t, add_special_tokens=False).ids
        assert (r.n_tokens, r.ids_sha256, r.decoded_sha256) == (len(ids), hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest(), hashlib.sha256(tokenizer.decode(ids, skip_special_tokens=False).encode()).hexdigest())


def test_bpe_on_noise(tokenizer):
    with open(bpe.default_path()) as f:
        a = bpe.compile_automaton(f.read())
    pieces = ["a", "aa", " ", "  ", "\n", "\t", "é", "日本", "'s", "'LL", "<|endoftext|>", "1", "22", "!!", "…", "the", " the", " ", "😀", "ing", "x" * 50, "\r\n", "\x00", "́"]
    r = random.Random(9)
    for _ in range(3000):
        s = "".join(r.choice(pieces) for _ in range(r.randint(0, 14)))
        ids = tokenizer.encode(s, add_special_tokens=False).ids
        assert a.encode(s) == np.array(ids, "<u4").tobytes(), s
        assert a.decode(a.encode(s)).decode() == tokenizer.decode(ids, skip_special_tokens=False)


def test_bpe_automaton_by_hand():
    """Merges of equal letters, from the left; and a pair that an earlier merge takes away."""
    letters = {bytes([b]): b for b in range(256)}
    a = bpe.Automaton([(b"a", b"a"), (b"b", b"c"), (b"a", b"b")], letters | {b"aa": 256, b"bc": 257, b"ab": 258}, {})
    assert a.path(b"aaa") == [256, 97] and a.path(b"abc") == [97, 257] and a.path(b"ab") == [258] and a.path(b"aab") == [256, 98] and a.path(b"aaab") == [256, 258]


def by_merging(word: bytes, merges: list[tuple[bytes, bytes]]) -> list[bytes]:
    """The pair of the earliest merge, leftmost first, until none is left."""
    rank = {}
    for k, m in enumerate(merges):
        rank.setdefault(m, k)
    out = [bytes([b]) for b in word]
    while True:
        best = min(((rank[p], i) for i, p in enumerate(zip(out, out[1:])) if p in rank), default=None)
        if best is None:
            return out
        i = best[1]
        out[i : i + 2] = [out[i] + out[i + 1]]


@pytest.mark.parametrize("seed", range(12))
def test_bpe_automata_of_random_merges(seed):
    """Also with merges that never come to pass, as earlier ones take their pairs."""
    r = random.Random(seed)
    tokens, merges = [b"a", b"b", b"c"], []
    for _ in range(40):
        u, v = r.choice(tokens), r.choice(tokens)
        if len(u + v) <= 7 and u + v not in tokens:
            merges.append((u, v))
            tokens.append(u + v)
    ids = {bytes([b]): b for b in range(256)}
    for t in tokens[3:]:
        ids[t] = len(ids)
    a = bpe.Automaton(merges, ids, {})
    words = [bytes(r.choice(b"abc") for _ in range(r.randint(1, 24))) for _ in range(300)]
    want = [[ids[t] for t in by_merging(w, merges)] for w in words]
    assert [a.path(w) for w in words] == want
    assert a.encode_words(words) == [np.array(w, "<u4").tobytes() for w in want]


def test_bpe_of_long_unbroken_words(tokenizer, monkeypatch):
    """In time linear in the word: a million characters take seconds."""
    with open(bpe.default_path()) as f:
        a = bpe.compile_automaton(f.read())
    monkeypatch.setattr(bpe, "BLOCK", 70_000)
    for s in ("漢字仮名" * 30_000, "ab" * 50_000 + "c", "".join(random.choice("etaoinshr") for _ in range(200_000))):
        assert a.encode(s) == np.array(tokenizer.encode(s, add_special_tokens=False).ids, "<u4").tobytes()
    assert a.decode(a.encode("q" * 1_000_000)) == b"q" * 1_000_000


# 10


def test_lm(docs, spark):
    data = [(i, t) for i, t, _ in ROWS]
    want = brute.unigram(data)
    got = sorted(lm.lm_scores(docs).collect(), key=lambda r: (r.doc_id is None, r.doc_id or 0))
    want.sort(key=lambda r: (r[0] is None, r[0] or 0))
    assert len(got) == len(want)
    for r, w in zip(got, want):
        assert (r.doc_id, r.held_out, r.n_tokens, r.n_known, r.train_tokens) == w[:5] and r.base_score == pytest.approx(w[5], rel=1e-9)


def test_lm_beats_its_base_and_is_normalised(spark, monkeypatch):
    monkeypatch.setattr(lm, "WORDS", 12)
    r = random.Random(3)
    follow = {w: r.sample(VOCABULARY, 2) for w in VOCABULARY}

    def walk(n: int) -> str:
        w = [r.choice(VOCABULARY)]
        while len(w) < n:
            w.append(r.choice(follow[w[-1]]) if r.random() < 0.95 else f"rare{r.randrange(30)}" if r.random() < 0.5 else r.choice(VOCABULARY))
            if w[-1] not in follow:
                w.append(r.choice(VOCABULARY))
        return " ".join(w)

    df = spark.createDataFrame([(i, walk(80)) for i in range(200)], "doc_id long, text string")
    held = [x for x in lm.lm_scores(df).collect() if x.held_out]
    assert held and sum(x.score for x in held) > sum(x.base_score for x in held) + 5 * len(held)
    p = np.exp(lm.train(np.random.default_rng(0).integers(0, 9, (15, 14)).astype(float)))
    assert np.allclose(p.sum(1), 1)


def test_lm_words_outside_the_core_have_contexts(spark, monkeypatch):
    """x follows a and y follows b, and c follows x and d follows y; x and y are as frequent and both outside the core."""
    monkeypatch.setattr(lm, "WORDS", 4)
    learned = [i for i in range(300) if brute.crc(i) % 10]
    held = [i for i in range(300, 600) if brute.crc(i) % 10 == 0][:2]
    rows = [(i, "a x c " * 9 + "b y d " * 9) for i in learned] + [(held[0], "a x c b y d"), (held[1], "a y c b x d")]
    for i in range(2):  # fillers make the core's words the most frequent
        rows += [(k, "a b c d " * 3) for k in learned]
    r = {x.doc_id: x for x in lm.lm_scores(spark.createDataFrame(rows, "doc_id long, text string")).collect() if x.doc_id in held}
    right, wrong = r[held[0]], r[held[1]]
    assert right.base_score == pytest.approx(wrong.base_score) and right.score > wrong.score + 1


def test_lm_is_normalised_over_all_words(spark, monkeypatch):
    """Texts of at most two tokens give P(word | start) by P(end | u) + sum over v of P(v | u) = 1; these must sum to one too."""
    monkeypatch.setattr(lm, "WORDS", 3)
    r = random.Random(5)
    learned = [i for i in range(200) if brute.crc(i) % 10][:80]
    rows = [(i, " ".join(r.choice("abc") if r.random() < 0.5 else f"w{r.randrange(9)}" for _ in range(r.randrange(9)))) for i in learned]
    words = sorted({w for _, t in rows for w in t.split()}) + ["unseen"]
    asked = ["", *words, *[f"{u} {v}" for u in words for v in words]]
    held = [i for i in range(200, 20000) if brute.crc(i) % 10 == 0][: len(asked)]
    got = {x.doc_id: x.score for x in lm.lm_scores(spark.createDataFrame([*rows, *zip(held, asked)], "doc_id long, text string")).collect()}
    p = 10 ** np.array([got[i] for i in held])
    one, two = p[1 : 1 + len(words)], p[1 + len(words) :].reshape(len(words), -1)
    start = np.linalg.solve(np.eye(len(words)) - two / one, one)
    assert len(words) == 13 and (start > 0).all() and start.sum() + p[0] == pytest.approx(1, abs=1e-5)


def test_lm_occurrences_go_once():
    """One pass sends all rows' words outside the core; vectors come from the training rows' alone, and meet both."""
    rows = [(i, "a b " * 3 + f"w{i} w{i % 3}") for i in range(40)]
    vocabulary, parts = {b"a": 0, b"b": 1}, 3
    batch = pa.RecordBatch.from_arrays([pa.array(range(40)), *map(pa.array, zip(*rows))], ["uid", "doc_id", "text"])
    pairs = np.random.default_rng(1).integers(1, 9, (5, 4)).astype(float)
    core = lm.learn_core(pairs, steps=5)
    sent = [m for b in lm.score_texts(vocabulary, np.zeros(4), np.zeros((5, 4)), True, parts)(iter([batch])) for m in b.to_pylist()]
    words = {k: sorted((w, int(n)) for m in sent if m["kind"] == k for w, n in zip(*lm.unpack_rare(m["payload"])[2:4])) for k in (lm.RARE, lm.ASKED)}
    for k, held in ((lm.RARE, False), (lm.ASKED, True)):
        want = brute.Counter(w for i, t in rows if lm.held_out(i) == held for w in t.encode().split() if w not in vocabulary)
        assert words[k] == sorted(want.items()) and want
    known = {w for w, _ in words[lm.RARE]}
    seen = {i: 0 for i, _ in rows}
    for p in range(parts):
        learned = list(lm.learn_rare(core, pairs, 100.0)(iter([lm._rows([tuple(m.values()) for m in sent if m["part"] == p])])))
        for m in (m for b in lm.meet_vectors(parts, core, np.zeros(5))(iter(learned)) for m in b.to_pylist()):
            if m["kind"] == lm.SUMS:
                _, n = lm.struct.unpack_from("<ii", m["payload"])
                for u, x in zip(np.frombuffer(m["payload"], np.int64, n, 8), np.frombuffer(m["payload"], np.float32, n, 8 + 24 * n)):
                    seen[int(u)] += int(x)
    assert seen == {i: sum(w in known for w in t.encode().split()) for i, t in rows}


def test_lm_without_training_rows(spark):
    i = next(k for k in range(1000) if brute.crc(k) % 10 == 0)
    (r,) = lm.lm_scores(spark.createDataFrame([(i, "a b")], "doc_id long, text string")).collect()
    assert (r.held_out, r.n_tokens, r.n_known, r.train_tokens) == (True, 3, 0, 0) and r.base_score == pytest.approx(0)


# Outputs whose digests the queries give


def test_text_media_gives_the_files(docs):
    digests = sorted(map(tuple, media.media_features(docs).select("doc_id", "n_bytes", "media_sha256", "feature", "tile_sha256").collect()), key=repr)
    sha = lambda b: hashlib.sha256(b).hexdigest()
    got = media.text_media(docs).collect()
    assert sorted(((r.doc_id, r.n_bytes, sha(r.media), r.feature, sha(r.tile)) for r in got), key=repr) == digests
    texts = sorted(media.decode(bytes(r.media)).tobytes()[: r.n_bytes] for r in got)
    assert texts == sorted((t or "").encode() for _, t, _ in ROWS)
    assert all(np.load(io.BytesIO(r.tile)).shape[:2] == (16, 16) for r in got)


def test_clean_texts_gives_texts_and_spans(spark):
    p = prose(20)
    rows = [(1, "one " + p + " end"), (2, "another " + p + " tail"), (3, None)]
    raw = {i: (t or "").encode() for i, t in rows}
    got = {r.doc_id: r for r in suffix_dedup.clean_texts(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert [len(got[i].spans) for i in (1, 2, 3)] == [0, 1, 0] and bytes(got[1].kept) == raw[1] and bytes(got[3].kept) == b""
    (s,) = got[2].spans
    assert p.encode() in raw[2][s.start : s.stop] and bytes(got[2].kept) == raw[2][: s.start] + raw[2][s.stop :]


# All


@pytest.mark.parametrize("f", [simhash.simhash_components, simhash.keep_one_per_component, mixing.repeated, exact_dedup.exact_dedup, exact_dedup.keep_one_per_text, sharding.shard_rows, media.media_features, suffix_dedup.remove_repeats, mixing.mix, pii.find_pii, bpe.bpe_rows, lm.lm_scores], ids=lambda f: f.__name__)
def test_empty_tables(none, f):
    assert f(none).count() == 0
