"""Each operator against a plain version, and its stated results on odd rows."""
import hashlib
import random
import zlib

import numpy as np
import public_tokenizers
import pytest

import brute
from tabreg.llm import (bwt, golay, language_id, lattice, lookup, packing, ppm, queries, toxicity, url_trees,
                        wumanber)

SMALL = "/root/testdata/sf0.001"
DOCS = "doc_id long, text string, lang string, source string, n_chars long"
#: Names that the operators use inside or give to their results.
CLASH = ", row_key string, ranges string, slot string, component_id string, `odd name` int"


def documents(spark, texts, clash=False):
    rows = [(i, t, "en", "s", None if t is None else len(t)) for i, t in enumerate(texts)]
    if clash:
        return spark.createDataFrame([(*r, "k", "r", "s", "c", 1) for r in rows], DOCS + CLASH)
    return spark.createDataFrame(rows, DOCS)


def blurb(rng, n, alphabet="abcde"):
    return " ".join("".join(rng.choice(alphabet) for _ in range(rng.randint(1, 6))) for _ in range(n))


ODD = [None, "", " ", "\x00", "a", "a", "é" * 500, "A" * 30_000, "x y z", "x y z", "\t\n", "🙂 ß ñ"]


# ---- suffix-array dedup --------------------------------------------------------------------------

@pytest.mark.parametrize("alphabet", ["a", "ab", "abcdefgh é"])
def test_repeated_starts(alphabet):
    rng = random.Random(alphabet)
    for _ in range(25):
        parts = ["".join(rng.choice(alphabet) for _ in range(rng.randint(0, 50))).encode() for _ in range(rng.randint(1, 7))]
        n = rng.choice([1, 3, 9])
        count = {}
        for p in parts:
            for i in range(len(p) - n + 1):
                count[p[i:i + n]] = count.get(p[i:i + n], 0) + 1
        want = [i + n <= len(p) and count[p[i:i + n]] > 1 for p in parts for i in range(len(p) + 1)]
        assert list(bwt.repeated_starts(parts, n)) == want


@pytest.mark.parametrize("hot", [2, 512])
def test_bwt_dedup_is_brute_force(spark, hot):
    rng = random.Random(5)
    shared = [blurb(rng, 14) for _ in range(3)]
    texts = [blurb(rng, rng.randint(0, 20)) + rng.choice(shared) + blurb(rng, rng.randint(0, 20)) for _ in range(40)]
    texts += [texts[0], texts[0], "ab" * 60, "é" * 40, *ODD[:7], "b" * 300]
    raw = [(t or "").encode() for t in texts]
    want = {i: brute.dedup_row(t, m) for i, (t, m) in enumerate(zip(raw, brute.covered(raw, 24)))}
    got = bwt.digests(documents(spark, texts), min_len=24, gram=8, hot=hot, block=512).collect()
    assert {r.doc_id: tuple(r)[1:] for r in got} == want


def test_bwt_many_copies_of_one_row(spark):
    """Repeated rows (same id and text), and many distinct texts that share a passage with them."""
    text = blurb(random.Random(3), 300)
    rows = [(None, text)] * 5000 + [(str(i), text[40:400] + f" {i} own") for i in range(20)]
    docs = spark.createDataFrame(rows, "doc_id string, text string").repartition(4)
    got = bwt.digests(docs).groupBy("doc_id", "n_bytes", "n_removed", "n_spans").count().collect()
    raw = [(t or "").encode() for _, t in rows[4999:]]
    raw = [raw[0]] + raw  # one more copy stands for the others
    want = {(i, *brute.dedup_row(t, m)[:3]): 1 for (i, _), t, m in zip(rows[4998:], raw, brute.covered(raw, 200))}
    assert {tuple(r)[:4]: r["count"] for r in got} == {k: 5000 if k[0] is None else 1 for k in want}


def test_bwt_very_long_text(spark, monkeypatch):
    rng = random.Random(1)
    text = blurb(rng, 400) + "#" + blurb(random.Random(2), 30) + "-" * 5 + blurb(random.Random(2), 30)
    data, off = np.frombuffer(text.encode(), np.uint8), np.array([0, len(text.encode())])
    whole = {(int(r), int(a), int(n)) for x in bwt._runs(data, off, 40, 10) for r, a, n in zip(*x[:3])}
    monkeypatch.setattr(bwt, "_SEGMENT", 256)
    cut = sorted((int(r), int(a), int(n)) for x in bwt._runs(data, off, 40, 10) for r, a, n in zip(*x[:3]))
    places = lambda runs: sorted(p for _, a, n in runs for p in range(a, a + n))
    assert places(cut) == places(whole) == list(range(len(text.encode()) - 40 + 1))


def test_bwt_without_repeats_keeps_rows_and_columns(spark):
    rng = random.Random(8)
    twice = blurb(rng, 20)
    texts = ["é" + twice + "é one", "ñ" + twice + "ü two", None, "alone", twice, twice]
    docs = documents(spark, texts, clash=True)
    out = bwt.without_repeats(docs, min_len=24, gram=8)
    assert out.columns == docs.columns and [f.dataType for f in out.schema] == [f.dataType for f in docs.schema]
    got = {r.doc_id: r for r in out.collect()}
    assert len(got) == 6 and got[2].text is None and got[3].text == "alone" and got[4].text == "" == got[5].text
    assert got[0].text == "éé one" and got[1].text == "ñü two" and got[0].n_chars == 6
    assert got[2].n_chars is None and got[3].row_key == "k"


# ---- benchmark decontamination -------------------------------------------------------------------

@pytest.mark.parametrize("chunk", [1 << 20, 700])
def test_wu_manber_is_brute_force(spark, chunk):
    rng = random.Random(3)
    items = [(i, blurb(rng, rng.randint(0, 25), "abé")) for i in range(14)] + [(50, None), (51, "..."), (52, "Zz"), (53, "Zz")]
    there = [t for _, t in items if t]
    texts = [blurb(rng, 5) + " " + rng.choice(there).upper().replace(" ", rng.choice([" ", "\n", " - "])) + " " + blurb(rng, 30)
             for _ in range(30)]
    texts = texts + ["zz", "azz", *ODD, *[t for _, t in items if t]]
    bench = spark.createDataFrame([(i, t, 1) for i, t in items], "item_id long, text string, pattern int")
    got = {r.doc_id: r for r in wumanber.digests(documents(spark, texts), bench, chunk_bytes=chunk).collect()}
    for i, (n, hit, ids) in enumerate(brute.contamination(texts, items)):
        r = got[i]
        assert (r.n_words, r.n_hit, r.n_items) == (n, hit, len(ids)), i
        assert r.items_sha256 == hashlib.sha256(",".join(ids).encode()).hexdigest()
        assert r.contaminated == (hit > 0 and 20 * hit >= n)


def test_wu_manber_clean_and_empty(spark):
    bench = spark.createDataFrame([(1, blurb(random.Random(1), 20))], "item_id long, text string")
    passage = bench.first().text
    docs = documents(spark, ["fine text", passage, None, blurb(random.Random(2), 3000, "xyz") + " " + passage], clash=True)
    out = wumanber.clean(docs, bench)
    assert out.columns == docs.columns
    assert sorted(r.doc_id for r in out.collect()) == [0, 2, 3]  # under one word in twenty: stays
    assert wumanber.clean(docs, bench.limit(0)).count() == 4
    assert wumanber.clean(docs.limit(0), bench).count() == 0


# ---- SimHash by Golay codes ----------------------------------------------------------------------

def test_golay_decodes_three_errors():
    rng = np.random.default_rng(1)
    data = rng.integers(0, 1 << 12, 500)
    word = data << 11
    s = np.zeros(len(word), np.int64)
    for i in range(23):
        s ^= np.where(word >> i & 1, golay._BIT[i], 0)
    word |= s  # check bits
    for _ in range(6):
        bad = word.copy()
        for _ in range(3):
            bad ^= 1 << rng.integers(0, 23, len(word))
        assert (golay.decode(bad) == data).all()


def test_golay_keys_meet_at_four_bits():
    rng = np.random.default_rng(2)
    a = rng.integers(0, 1 << 63, 4000, dtype=np.uint64)
    b = a.copy()
    for i in range(len(b)):
        for bit in rng.choice(64, rng.integers(0, 5), replace=False):
            b[i] ^= np.uint64(1 << int(bit))
    ka, kb = {}, {}
    for k, x in ((ka, a), (kb, b)):
        for r, key in zip(*golay.keys(x)):
            k.setdefault(int(r), set()).add(int(key))
    assert all(ka[i] & kb[i] for i in range(len(a)))
    assert max(len(x) for x in ka.values()) <= 36


@pytest.mark.parametrize("cap", [3, 2048])
def test_golay_near_duplicates_are_brute_force(spark, cap):
    rng = random.Random(4)
    base = [blurb(rng, 60) for _ in range(8)]
    texts = [*ODD, *base]
    for _ in range(60):
        w = rng.choice(base).split()
        for _ in range(rng.randint(0, 2)):
            w[rng.randrange(len(w))] = "zz"
        texts.append(" ".join(w).upper() if rng.random() < .3 else "  ".join(w))
    fps = [brute.fingerprint(t) for t in texts]
    lab = brute.groups(len(fps), lambda i, j: bin(fps[i] ^ fps[j]).count("1") <= 4)
    got = {r.doc_id: r for r in golay.digests(documents(spark, texts), cap=cap).collect()}
    assert {i: (r.fingerprint, r.component_id) for i, r in got.items()} == {
        i: (f"{f:016x}", c) for i, (f, c) in enumerate(zip(fps, lab))}
    docs = documents(spark, texts, clash=True)
    kept = golay.keep_one(docs)
    assert kept.columns == docs.columns and sorted(r.doc_id for r in kept.collect()) == sorted(set(lab))


def test_golay_repeated_ids_and_empty(spark):
    docs = spark.createDataFrame([(1, "a b c d e"), (1, "a b c d e"), (None, "q r s"), (2, "q r s")], "doc_id long, text string")
    out = golay.digests(docs).collect()
    assert len(out) == 4 and {r.component_id for r in out} == {1, 2}
    assert sorted(r.doc_id for r in golay.keep_one(docs).collect()) == [1, 2]
    assert golay.digests(docs.limit(0)).count() == 0 and golay.keep_one(docs.limit(0)).count() == 0


def test_golay_keep_one_row_of_every_component(spark):
    """Null ids, ids that components share, and repeated rows: by brute force, the least id (nulls last), then content."""
    rng = random.Random(8)
    base = [blurb(rng, 40) for _ in range(7)]
    rows = [(None, base[0], 1), (None, base[1], 1), (None, base[1], 0), (None, base[2], 1), (None, None, 1), (None, "", 1),
            (5, base[3], 1), (5, base[4], 1), (5, base[4] + " ", 1), (6, base[4], 1),  # an id of two components
            (7, base[5], 1), (None, base[5], 1), (5, base[5], 2), (5, base[5], 1),
            (8, base[6], 3), (8, base[6], 3), (None, base[6].upper(), 1)]
    fps = [brute.fingerprint(t) for _, t, _ in rows]
    lab = brute.groups(len(rows), lambda i, j: bin(fps[i] ^ fps[j]).count("1") <= 4)
    order = lambda r: (r[0] is None, r[0] or 0, r[1] is not None, r[1] or "", r[2])
    want = [min((rows[i] for i in range(len(rows)) if lab[i] == c), key=order) for c in sorted(set(lab))]
    assert len(want) == 8
    got = golay.keep_one(spark.createDataFrame(rows, "doc_id long, text string, n int")).collect()
    assert sorted(map(tuple, got), key=order) == sorted(want, key=order)


# ---- embedding near-dedup ------------------------------------------------------------------------

def test_e8_nearest_is_nearest():
    rng = np.random.default_rng(0)
    x = rng.normal(size=(300, 8)) * 2
    p = lattice.nearest(x)
    twice = np.rint(p * 2)
    assert np.allclose(twice, p * 2)
    assert all((set(np.unique(r % 2)) in ({0.0}, {1.0})) for r in twice) and (np.rint(p.sum(1)) % 2 == 0).all()
    d = ((x - p) ** 2).sum(1)
    step = ((x[:, None] - p[:, None] - lattice.MINIMAL[None]) ** 2).sum(2).min(1)
    assert (d <= step + 1e-12).all() and len(lattice.MINIMAL) == 240


@pytest.mark.parametrize("cap", [8, 1024])
def test_lattice_is_brute_force(spark, cap):
    rng = np.random.default_rng(3)
    rows = []
    for c in range(12):
        v = rng.normal(size=64)
        for _ in range(rng.integers(1, 12)):
            u = v / np.linalg.norm(v) + rng.normal(size=64) * rng.choice([0.0, .01, .03])
            rows.append([float(np.float32(x)) for x in u * rng.uniform(.1, 9)])
    lab = [int(x) for x in rng.integers(0, 2, len(rows))]
    rows += [rows[0], None, [0.0] * 64, [float("nan")] * 64, [float("inf")] + [1.0] * 63, [None] + [1.0] * 63, [], [1.0, 2.0], [2.0, 4.0], rows[1]]
    lab += [lab[0], 0, 0, 0, 0, 0, 0, 1, 1, None]
    df = spark.createDataFrame([(i, v, c, 1) for i, (v, c) in enumerate(zip(rows, lab))],
                               "vec_id long, embedding array<float>, label int, node int")

    def unit(v):
        if not v or any(x is None or not np.isfinite(x) for x in v) or not any(v):
            return None
        a = np.array(v, np.float32).astype(float)
        return a / np.linalg.norm(a)
    us = [unit(v) for v in rows]
    link = lambda i, j: (lab[i] is not None and lab[i] == lab[j] and us[i] is not None and us[j] is not None
                         and len(us[i]) == len(us[j]) and float(us[i] @ us[j]) >= .93)
    comp = brute.groups(len(rows), link)
    want = {i: (sum(link(i, j) for j in range(len(rows)) if j != i), comp[i], comp[i] == i) for i in range(len(rows))}
    got = {r.vec_id: tuple(r)[1:] for r in lattice.digests(df, cap=cap, tables=12).collect()}
    assert got == want
    assert lattice.digests(df.limit(0)).count() == 0


def test_lattice_recall_at_the_threshold():
    rng = np.random.default_rng(9)
    x = rng.normal(size=(1500, 64))
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    noise = rng.normal(size=x.shape)
    noise -= (noise * x).sum(1, keepdims=True) * x
    noise /= np.linalg.norm(noise, axis=1, keepdims=True)
    for cos, least in ((.935, .9), (.96, .97), (.98, .995)):
        y = cos * x + np.sqrt(1 - cos * cos) * noise
        how = (lattice.TABLES, lattice.PROBES, lattice.SCALE, lattice.SEED)
        a, b = lattice.cells(x, *how), lattice.cells(y, *how)
        met = (a[:, :, :, None] == b[:, :, None, :]).any((1, 2, 3)).mean()
        assert met >= least, (cos, met)


def test_lattice_production_recall_at_093():
    rng = np.random.default_rng(9)
    x = rng.normal(size=(4000, 64))
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    noise = rng.normal(size=x.shape)
    noise -= (noise * x).sum(1, keepdims=True) * x
    noise /= np.linalg.norm(noise, axis=1, keepdims=True)
    y = .93 * x + np.sqrt(1 - .93 ** 2) * noise
    how = (lattice.TABLES, lattice.PROBES, lattice.SCALE, lattice.SEED)
    a, b = lattice.cells(x, *how), lattice.cells(y, *how)
    assert (a[:, :, :, None] == b[:, :, None, :]).any((1, 2, 3)).mean() >= .998


# ---- packing -------------------------------------------------------------------------------------

def test_encoder_is_the_tokenizer():
    rng = random.Random(0)
    enc = packing.Encoder(*queries.TOKENIZER)
    signs = [" ", " ", "\n", "a", "Bc", "1", "'s", "é", ".", "\t", "\xa0", "<|endoftext|>", "🙂", "\x00", "<|"]
    for t in ["", *("".join(rng.choice(signs) for _ in range(rng.randint(0, 14))) for _ in range(1500))]:
        assert list(enc(t)) == list(enc.slow(t))


@pytest.mark.parametrize("sign", [" ", "\n"])
def test_encoder_of_a_million_blanks(sign):
    enc = packing.Encoder(*queries.TOKENIZER)
    t = "a" + sign * 1_000_000 + "b"
    assert np.array_equal(enc(t), enc.slow(t))


def test_plan_uses_every_piece_once_and_few_sequences():
    rng = np.random.default_rng(1)
    for size, n in ((64, 500), (2048, 4000)):
        lens = np.minimum(rng.lognormal(np.log(size / 4), 1, n).astype(int) + 1, size)
        hist = np.bincount(lens, minlength=size + 1)
        plan = packing.plan(hist, size)
        used = np.zeros(size + 1, int)
        for p, k in plan:
            assert sum(p) <= size and k > 0
            np.add.at(used, list(p), k)
        assert (used == hist).all()
        total, greedy = sum(k for _, k in plan), sum(k for _, k in packing.best_fit(hist, size))
        assert total <= 1.01 * greedy + 1 and total >= lens.sum() / size


def test_pack_rows(spark):
    rng = random.Random(2)
    texts = [blurb(rng, rng.choice([0, 3, 50, 900, 4000])) for _ in range(60)] + ODD
    out = packing.pack(documents(spark, texts, clash=True), queries.TOKENIZER, size=512).collect()
    enc = packing.Encoder(*queries.TOKENIZER)
    by_doc, by_seq = {}, {}
    for r in out:
        by_doc.setdefault(r.doc_id, []).append(r)
        by_seq.setdefault(r.sequence_id, []).append(r)
    assert set(by_doc) == set(range(len(texts)))
    for i, rows in by_doc.items():
        ids = np.append(enc.slow(texts[i] or ""), 0).astype("<u4")
        rows.sort(key=lambda r: r.piece)
        assert [r.piece for r in rows] == list(range(-(-len(ids) // 512))) and all(r.length == 512 for r in rows[1:])
        at = 0
        for r in rows:
            assert r.start == at and r.ids_crc32 == zlib.crc32(ids[at:at + r.length])
            at += r.length
        assert at == len(ids)
    for rows in by_seq.values():
        at = 0
        for r in sorted(rows, key=lambda r: r.offset):
            assert r.offset == at
            at += r.length
        assert at <= 512
    assert packing.pack(documents(spark, []), queries.TOKENIZER).count() == 0


# ---- prediction by partial matching --------------------------------------------------------------

@pytest.mark.parametrize("shard_rows,order", [(1 << 20, 5), (1 << 20, 0), (40, 3)])
def test_ppm_is_brute_force(spark, shard_rows, order):
    rng = random.Random(6)
    texts = [blurb(rng, rng.randint(0, 12), "abcé") for _ in range(40)] + ODD[:7] + ODD[8:]
    got = {r.doc_id: r for r in ppm.digests(documents(spark, texts, clash=True), order=order, shard_rows=shard_rows).collect()}
    out = [zlib.crc32(str(i).encode()) % 7 == 2 for i in range(len(texts))]
    train = [(t or "").encode() for t, h in zip(texts, out) if not h]
    words = [[*brute.low(t).split(), None] for t in texts]
    count = {}
    for w, h in zip(words, out):
        for x in w if not h else ():
            count[x] = count.get(x, 0) + 1
    n, v = sum(count.values()), len(count)
    for i, t in enumerate(texts):
        r = got[i]
        assert (r.held_out, r.n_tokens, r.train_tokens) == (out[i], len(words[i]), n)
        assert r.n_known == sum(x in count for x in words[i])
        assert r.base_score == pytest.approx(sum(np.log10((count.get(x, 0) + 1) / (n + v + 1)) for x in words[i]))
        assert r.score == pytest.approx(brute.ppm_score(train, (t or "").encode(), order))


def test_ppm_probabilities_sum_to_one():
    rng = random.Random(1)
    data = blurb(rng, 200).encode()
    d, off = np.frombuffer(data, np.uint8), np.array([0, len(data)])
    u, n = np.unique(ppm._symbols(d, off, 0, 1, 3)[0], return_counts=True)
    trie = ppm.Trie(u, n, 3)
    for ctx in (b"abc", b"a a", b"\xff\xff\xff", b" e "):
        base = sum(np.uint64(b + 1) << np.uint64(9 * (3 - i)) for i, b in enumerate(ctx))
        assert (10 ** trie.log10(base | np.arange(257, dtype=np.uint64))).sum() == pytest.approx(1)


def test_ppm_empty_and_untrained(spark):
    assert ppm.digests(documents(spark, [])).count() == 0
    held = next(i for i in range(50) if zlib.crc32(str(i).encode()) % 7 == 2)
    r = ppm.digests(spark.createDataFrame([(held, "ab")], "doc_id long, text string")).first()
    assert r.train_tokens == 0 and r.n_known == 0 and r.score == pytest.approx(-3 * np.log10(257))


# ---- sharding ------------------------------------------------------------------------------------

def _prefs(size):
    def of(name):
        h = lambda x: int(hashlib.md5(x.encode()).hexdigest()[:15], 16)
        return h(name + "/offset") % size, h(name + "/skip") % (size - 1) + 1
    return of


@pytest.mark.parametrize("n,size", [(1, 2), (3, 11), (16, 1601)])
def test_lookup_table_is_filled_by_turns(spark, n, size):
    names = lookup.shard_names(n)
    got = {r.slot: r.shard for r in lookup.lookup_table(spark, names, size).collect()}
    assert [got[i] for i in range(size)] == brute.lookup(names, size, _prefs(size))
    counts = [list(got.values()).count(x) for x in names]
    assert max(counts) - min(counts) <= 1


def test_lookup_moves_few_keys_and_keeps_rows(spark):
    names = lookup.shard_names(8)
    a = {r.slot: r.shard for r in lookup.lookup_table(spark, names, 809).collect()}
    b = {r.slot: r.shard for r in lookup.lookup_table(spark, names[:-1], 809).collect()}
    moved = sum(a[i] != b[i] for i in a if a[i] != names[-1])
    assert moved < 0.15 * len(a)
    docs = documents(spark, ODD, clash=True)
    out = lookup.place(docs, "doc_id", names, slot_col="at", shard_col="to")
    assert out.columns == [*docs.columns, "at", "to"] and out.count() == len(ODD)
    plan = out._jdf.queryExecution().toString()
    assert "Python" not in plan and "Arrow" not in plan and "BroadcastHashJoin" in plan
    both = lookup.place(spark.createDataFrame([(1, "a", "b", "c")], "doc_id long, slot string, slot_input string, shard string"), "doc_id", names)
    assert both.columns == ["doc_id", "slot_input_", "slot_input", "shard_input", "slot", "shard"] and both.first()[1:4] == ("a", "b", "c")
    odd = spark.createDataFrame([(None,), (1,), (1,)], "doc_id long")
    assert lookup.place(odd, "doc_id", names).count() == 3
    with pytest.raises(ValueError):
        lookup.lookup_table(spark, names, 810)


def test_write_shards(spark, scratch):
    docs = documents(spark, ODD)
    lookup.write_shards(docs, "doc_id", scratch + "/shards", lookup.shard_names(4))
    assert spark.read.parquet(scratch + "/shards").count() == len(ODD)


# ---- language ID ---------------------------------------------------------------------------------

def test_language_held_out_accuracy_and_rejects(spark):
    docs = spark.read.parquet(SMALL + "/documents.parquet")
    model = language_id.fit(docs.where("doc_id % 2 = 0"))
    judged = language_id.identify(docs.where("doc_id % 2 = 1"), model, host_col="source")  # without the declared language
    both = judged.join(docs.select("doc_id", "lang"), judged.id == docs.doc_id).collect()
    assert np.mean([r.language == r.lang for r in both]) > .97 and np.mean([r.accepted for r in both]) > .99
    odd = spark.createDataFrame([(1, "Это совершенно другой язык, которого модель не видела " * 5, None, None),
                                 (2, None, None, None), (3, "", "en", "src1"), (4, both[0]["language"], None, None),
                                 (5, "1234 567", None, None)], "doc_id long, text string, lang string, source string")
    got = {r.id: r for r in language_id.identify(odd, model, host_col="source", declared_col="lang").collect()}
    assert not got[1].accepted and got[1].language == "und"
    assert not got[2].accepted and not got[5].accepted and got[2].text_language is None
    assert len(got) == 5


def test_language_evidence_moves_the_posterior(spark):
    docs = spark.read.parquet(SMALL + "/documents.parquet")
    model = language_id.fit(docs)
    pages = spark.createDataFrame(
        [(i, "de la les des une", f"http://www.h{i % 2}.fr/x", "fr") for i in range(20)] +
        [(50, "la de", "http://www.h1.fr/x", None), (51, "la de", None, "fr"), (52, "la de", None, None)],
        "page_id long, text string, url string, declared string")
    rows = pages.select("page_id", "text", "declared", *(c.alias(n) for n, c in language_id.address(pages.url).items()))
    got = {r.id: r for r in language_id.identify(rows, model, id_col="page_id", host_col="host", domain_col="domain",
                                                 suffix_col="suffix", declared_col="declared").collect()}
    assert len(got) == 23 and got[50].language == "fr"


def test_language_keep_known_keeps_columns(spark):
    docs = documents(spark, [*ODD, "the and of to in is that"], clash=True)
    out = language_id.keep_known(docs, language_id.fit(spark.read.parquet(SMALL + "/documents.parquet")),
                                 host_col="source", declared_col="lang")
    assert out.columns == docs.columns and 12 in {r.doc_id for r in out.collect()}
    empty = docs.limit(0)
    assert language_id.keep_known(empty, language_id.fit(empty)).count() == 0


def test_language_keep_known_tells_evidence_apart(spark):
    """Rows that share id and text: those with evidence stay when the one without goes."""
    model = language_id.fit(spark.read.parquet(SMALL + "/documents.parquet"))
    rows = [(None, "", "en", "s1"), (None, "", None, None), (None, None, "en", "s1"), (7, "", None, None), (7, "", "en", "s1"),
            *((i, "the and of to in is that it was for " * 5, "en", "s1") for i in range(10, 40))]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string")
    out = language_id.keep_known(docs, model, host_col="source", declared_col="lang").collect()
    assert sorted(map(str, map(tuple, out))) == sorted(str(r) for r in rows if r[2])


def test_language_models_of_every_label(spark):
    rng = random.Random(6)
    rows, i = [], 0
    for k in range(80):  # rarer and rarer languages, each with words of its own
        words = ["".join(rng.choice("abcdefghijklmnopqrstuvwxyz") for _ in range(rng.randint(3, 8))) for _ in range(12)]
        for _ in range(2 + (80 - k) // 10):
            rows.append((i, " ".join(rng.choice(words) for _ in range(60)), f"l{k:02d}"))
            i += 1
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    model = language_id.fit(docs)
    assert model.langs == sorted({r[2] for r in rows}) and model.table.shape == (81, language_id.BUCKETS)
    got = {r.id: r for r in language_id.identify(docs, model, declared_col="lang").collect()}
    assert all(got[i].language == got[i].text_language == lang and got[i].accepted for i, _, lang in rows)


# ---- toxicity ------------------------------------------------------------------------------------

def test_ordinal_recovers_shared_weights():
    rng = np.random.default_rng(0)
    x = rng.random((4000, 6)) < .3
    w = np.array([3.0, 2.0, 1.0, 0.0, 0.0, -2.0])
    y = np.digitize(x @ w + rng.logistic(size=4000), [1.0, 2.5, 4.0])
    row, col = np.nonzero(x)
    m = toxicity.Ordinal(6, 4).fit(row, col, y, np.ones(4000), penalty=1e-6, steps=800)
    assert np.allclose(m.w, w, atol=.35) and np.allclose(m.cuts, [1.0, 2.5, 4.0], atol=.35)
    p = m.probabilities(np.linspace(-30, 30, 50))
    assert np.allclose(p.sum(1), 1) and (p >= 0).all() and (np.diff(p @ np.arange(4)) >= 0).all()


def test_toxicity_held_out(spark):
    sf = "/root/testdata/sf0.1"
    labels = spark.read.parquet(sf + "/labels.parquet")
    docs = spark.read.parquet(sf + "/documents.parquet").join(labels.select("doc_id"), "doc_id", "left_semi")
    scorer = toxicity.fit(docs, labels.where("doc_id % 3 <> 0"))
    got = (toxicity.severity(docs, scorer).join(labels.select("doc_id", labels.toxic.alias("truth")), "doc_id")
           .where("doc_id % 3 = 0").collect())
    pos = np.array([r.p_toxic for r in got if r.truth == 1])
    neg = np.array([r.p_toxic for r in got if r.truth == 0])
    assert len(pos) > 100 and (pos >= .5).mean() > .7 and (neg >= .5).mean() < .01
    assert all(0 <= r.expected_severity <= 3 for r in got)


def test_toxicity_odd_rows(spark):
    docs = documents(spark, ODD)
    labels = spark.createDataFrame([(None, 1), (1, None), (4, 1), (4, 0), (5, 0), (6, 0), (9, 1)], "doc_id long, toxic int")
    assert toxicity.severity(docs, toxicity.fit(docs, labels)).count() == len(ODD)
    one = toxicity.severity(docs, toxicity.fit(docs, labels.where("toxic = 0"))).collect()
    assert len(one) == len(ODD) and not any(r.toxic for r in one)
    assert toxicity.severity(docs.limit(0), toxicity.fit(docs.limit(0), labels.limit(0))).count() == 0


# ---- URL filter ----------------------------------------------------------------------------------

def test_url_rules_and_trees(spark):
    urls = ["http://a.net/x", "https://A.Example.NET/en/1?q=1#z", "http://example.com/de/", "http://notexample.com/de/",
            "http://b.org/fr/x", "http://b.org/fr", "http://net", "net/x", None, "", "://", "http://x.com?u=http://y.net/",
            "HTTP://X.ORG/FR/", "ftp://c.org/fr/", "http://a.net/x"] + [f"http://h{i}.net/{i}" for i in range(20)]
    pages = spark.createDataFrame([(i, u, "k") for i, u in enumerate(urls)], "page_id long, url string, rule string")

    def judge(u):
        host = path = ""
        if u and "://" in u:
            rest = u.split("://", 1)[1]
            cut = min([i for i in (rest.find(c) for c in "/?#") if i >= 0], default=len(rest))
            host, tail = brute.low(rest[:cut]).decode(), rest[cut:]
            path = tail.split("?")[0].split("#")[0] if tail.startswith("/") else ""
        fit = [(h + p, v) for h, p, v in url_trees.RULES if (host == h or host.endswith("." + h)) and path.startswith(p)]
        return host, path, max(fit, key=lambda x: len(x[0]), default=(None, None))
    got = {r.page_id: r for r in url_trees.verdicts(pages, url_trees.fit(url_trees.rule_labels(pages))).collect()}
    assert len(got) == len(urls)
    for i, u in enumerate(urls):
        host, path, (rule, verdict) = judge(u)
        assert (got[i].host, got[i].path, got[i].rule) == (host, path, rule), u
        assert got[i].verdict == (verdict or got[i].verdict) and got[i].verdict in ("allow", "block")


def test_url_trees_learn(spark):
    rows = [(f"http://h{i % 7}.com/{'9' * 30 if i % 2 else 'word'}/{i}", i % 2) for i in range(200)]
    fitted = url_trees.fit(spark.createDataFrame(rows, "url string, label int"))
    test = spark.createDataFrame([(i, f"http://z{i}.com/{'9' * 30 if i % 2 else 'word'}/{i}") for i in range(40)], "page_id long, url string")
    got = url_trees.verdicts(test, fitted).collect()
    assert np.mean([(r.verdict == "block") == (r.page_id % 2 == 1) for r in got]) > .95


def test_url_features_are_the_plain_ones(spark):
    import math
    from pyspark.sql import functions as F
    rows = [("http://a.b.net/x/y-1?k=v&w=%20", 1), ("http://c.net/", 0), ("http://d.net/q_q", 1), ("http://e.org/9", 0), (None, 1)]
    labelled = spark.createDataFrame(rows, "u string, label int")
    fitted = url_trees.fit(labelled, "u")
    stats, total = fitted[1], fitted[2]
    src = labelled.select(F.col("u").alias("__url"), F.col("label").cast("double").alias("label"))
    host, path = url_trees.host_and_path(F.col("__url"))
    src = src.withColumn("__host", host).withColumn("__path", path)
    rate = 3 / 5
    for own in (None, "label"):
        for r in url_trees.features(src, stats, total, own).collect():
            u = r["__url"] or ""
            rest = u.split("://", 1)[1] if "://" in u else ""
            h = rest.split("/")[0]
            p = rest[len(h):].split("?")[0]
            same = [y for v, y in rows if ((v or "").split("://")[1].split("/")[0] if v else "").rsplit(".", 1)[-1] == h.rsplit(".", 1)[-1]]
            b, n = sum(same), len(same)
            if own:
                b, n = b - r["label"], n - 1
            assert (r["f_length"], r["f_host"], r["f_path"], r["f_depth"], r["f_labels"]) == (len(u), len(h), len(p), p.count("/"), h.count("."))
            assert r["f_digits"] == pytest.approx(sum(c.isdigit() for c in u) / max(len(u), 1))
            assert r["f_entropy"] == pytest.approx(-sum(u.count(c) / len(u) * math.log(u.count(c) / len(u)) for c in set(u)))
            assert (r["f_params"], r["f_hyphens"], r["f_escapes"]) == (u.count("=") + u.count("&"), u.count("-") + u.count("_"), u.count("%"))
            assert r["f_suffix_rate"] == pytest.approx((b + url_trees.SMOOTH * rate) / (n + url_trees.SMOOTH))
            assert r["f_suffix_share"] == pytest.approx(n / 5)


def test_url_empty(spark):
    none = spark.createDataFrame([], "page_id long, url string")
    assert url_trees.verdicts(none, url_trees.fit(url_trees.rule_labels(none))).count() == 0
