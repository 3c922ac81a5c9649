"""Line dedup, Merkle manifest and tokenizer alignment against plain versions, and their results on odd rows."""
import hashlib
import random
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest

import brute
from tabreg.llm import align, lines, merkle, queries
from test_operators import CLASH, DOCS, ODD, documents

FILES = (*queries.TOKENIZER, queries.PIECES)


def rows_of(spark, rows):
    return spark.createDataFrame(rows, DOCS)


# ---- line dedup ----------------------------------------------------------------------------------

WS = " \t\n\x0b\x0c\r"


def plain_lines(docs, min_docs, min_chars):
    """(lines, gone, digest) per (id, text)."""
    held = defaultdict(list)
    cut = [(i, (t or "").split("\n")) for i, t in docs]
    key = lambda x: brute.low(x.strip(WS)).decode()
    for i, ls in cut:
        for k in {key(x) for x in ls}:
            if len(k) >= min_chars:
                held[k].append(i)
    order = lambda i: (i is not None, i or 0)
    keeper = {k: max(v, key=order) for k, v in held.items() if len(v) >= min_docs}
    out = []
    for i, ls in cut:
        keep = [x for x in ls if key(x) not in keeper or keeper[key(x)] == i]
        out.append((i, len(ls), len(ls) - len(keep), hashlib.sha256("\n".join(keep).encode()).hexdigest()))
    return sorted(out, key=str)


@pytest.mark.parametrize("hot_keys,bits", [(2048, lines.MOST_BITS), (1, 1 << 16)])
def test_lines_is_brute_force(spark, hot_keys, bits):
    rng = random.Random(4)
    common = ["Shared line %d é, over many documents" % i for i in range(12)]
    rows = []
    for i in range(150):
        ls = [rng.choice(["  ", "", "\t"]) + rng.choice([str.upper, str.lower, str])(x) + rng.choice(["", " \r", "\x0b"])
              for x in rng.choices(common, weights=[60] + list(range(1, 12)), k=rng.randint(0, 3))]
        ls += ["only here %d, and long enough to be a key" % rng.randint(0, 10**9), "short"] * rng.randint(0, 2)
        rng.shuffle(ls)
        rows.append((i, "\n".join(ls)))
    rows += [(1000 + i, t) for i, t in enumerate(ODD)] + [(None, common[0]), (None, common[1]), (7, common[3] + "\n" + common[3])]
    rows += [rows[0]] * 3 + [(2000, "É" * 40 + "\n"), (2001, "\n".join([common[2]] * 50 + [""] * 3))]
    docs = rows_of(spark, [(i, t, "en", "s", 0) for i, t in rows])
    got = sorted((tuple(r) for r in lines.digests(docs, min_docs=5, min_chars=10, hot_keys=hot_keys, most_bits=bits).collect()), key=str)
    assert got == plain_lines(rows, 5, 10)


def test_lines_all_null_ids_stay(spark):
    rows = [(None, "a line that all of them hold")] * 6
    docs = rows_of(spark, [(i, t, "en", "s", 0) for i, t in rows])
    assert {r.n_dropped for r in lines.digests(docs, min_chars=10).collect()} == {0}


def test_lines_many_copies_of_one_row(spark):
    text = "\n".join("one of the lines of a text with number %d" % i for i in range(30))
    docs = spark.range(4000).selectExpr("if(id < 3999, 1L, 2L) doc_id", f"'{text}' text")
    got = lines.digests(docs).groupBy("doc_id", "n_dropped").count().collect()
    assert sorted(map(tuple, got)) == [(1, 30, 3999), (2, 0, 1)]


def test_lines_keeps_rows_and_columns(spark):
    line = "This line is shared by five documents or more"
    texts = [f"own {i}\n {line.upper() if i % 2 else line}\nend" for i in range(6)] + [None, ""]
    docs = documents(spark, texts, clash=True)
    out = lines.without_repeated_lines(docs)
    assert out.columns == docs.columns and [f.dataType for f in out.schema] == [f.dataType for f in docs.schema]
    got = {r.doc_id: r for r in out.collect()}
    assert got[0].text == "own 0\nend" and got[0].n_chars == 9 and got[5].text == texts[5] and got[6].text is None and got[7].text == ""
    with pytest.raises(ValueError):
        lines.without_repeated_lines(docs.withColumnRenamed("slot", "__line_gone"))


def test_lines_empty_table_and_long_line(spark):
    assert lines.digests(rows_of(spark, [])).collect() == []
    long_ = "x" * 1_000_000
    docs = rows_of(spark, [(i, long_ + "\n" + str(i), "en", "s", 0) for i in range(5)])
    assert sorted((r.doc_id, r.n_dropped) for r in lines.digests(docs).collect()) == [(i, int(i < 4)) for i in range(5)]


def test_filter_merges_as_one(spark):
    """Places that two keys set are found however the keys are dealt over batches."""
    docs = rows_of(spark, [(i, f"a line that comes twice {i % 50} " * 2, "en", "s", 0) for i in range(100)])
    texts = docs.selectExpr("text")
    one = lines.twice_seen(texts.coalesce(1), 1 << 16, 10)
    assert one == lines.twice_seen(texts.repartition(7), 1 << 16, 10) and any(one)


# ---- Merkle manifest -----------------------------------------------------------------------------

H = lambda *x: hashlib.sha256("".join(x).encode()).hexdigest()


def plain_tree(leaves):
    """Root, and per leaf its siblings from below."""
    level, at, proof = leaves, list(range(len(leaves))), [[] for _ in leaves]
    while len(level) > 1:
        for i, p in enumerate(at):
            if p ^ 1 < len(level):
                proof[i].append((level[p ^ 1], p & 1))
            else:
                proof[i].append((None, 0))
        level = [H(*level[i:i + 2]) for i in range(0, len(level), 2)]
        at = [p >> 1 for p in at]
    return level[0], proof


def plain_manifest(rows):
    f = lambda v: "-" if v is None else f"{len(str(v).encode())}:{v}"
    leaf = lambda i, t, g, s, n: H(f(i), f(s), f(g), f(n), f(t))
    groups = defaultdict(list)
    for r in rows:
        i, t, g, s, n = r
        bad = i is not None and zlib.crc32(str(i).encode()) % 7 == 0
        groups[g].append((i is not None, i or 0, leaf(*r), leaf(i, t, g, s, n + 1 if bad and n is not None else n), i))
    order = sorted(groups, key=lambda g: (g is not None, (g or "").encode()))
    trees = {g: plain_tree([x[2] for x in sorted(groups[g])]) for g in order}
    root, top = plain_tree([trees[g][0] for g in order])
    out = []
    for t, g in enumerate(order):
        for x, below in zip(sorted(groups[g]), trees[g][1]):
            path = below + top[t]
            h = x[3]
            for sib, odd in path:
                h = H(h) if sib is None else H(sib, h) if odd else H(h, sib)
            out.append((x[4], x[2], trees[g][0], root, H(*(s or "" for s, _ in path)), h, h == root))
    return sorted(out, key=str)


@pytest.mark.parametrize("bits,limit", [(4, 1 << 24), (1, 0), (2, 0)])
def test_merkle_is_brute_force(spark, bits, limit):
    rng = random.Random(2)
    sizes = {"en": 150, "de": 17, "É": 16, None: 3, "": 1, "zz": 33}
    rows, i = [], 0
    for g, k in sizes.items():
        for _ in range(k):
            i += 1
            rows.append((rng.choice([i, i, i, None]), rng.choice(ODD), g, rng.choice(["s", None]), rng.choice([None, 3, 14])))
    rows += [rows[0]] * 5
    got = sorted((tuple(r) for r in merkle.digests(rows_of(spark, rows), bits=bits, broadcast_bytes=limit).collect()), key=str)
    assert got == plain_manifest(rows)
    assert any(not r[-1] for r in got) and any(r[-1] for r in got)


def test_merkle_small_tables(spark):
    assert merkle.digests(rows_of(spark, [])).collect() == []
    one = (5, "t", "en", "s", 1)
    assert [tuple(r) for r in merkle.digests(rows_of(spark, [one])).collect()] == plain_manifest([one])


def test_merkle_many_groups_and_other_columns(spark):
    rows = [(i, "t", f"g{i % 300}", "s", i) for i in range(700)]
    docs = spark.createDataFrame([(*r, "k", "r", "s", "c", 1) for r in rows], DOCS + CLASH)
    assert sorted((tuple(r) for r in merkle.digests(docs).collect()), key=str) == plain_manifest(rows)


# ---- alignment -----------------------------------------------------------------------------------

def plain_alignment(texts):
    p = align.pair(FILES)
    a_of = lambda i: p.va.spell(np.array([i])).tobytes()
    b_of = lambda i: p.vb.spell(np.array([i])).tobytes()
    docs, held = [], Counter()
    for t in texts:
        groups = []
        if t:
            (a,), (b,) = p.encode([t])
            raw = (" " + t).encode()
            if b"".join(map(a_of, a)) == raw == b"".join(map(b_of, b)):
                i = j = 0
                while i < len(a):
                    ga, gb, ea, eb = [a[i]], [b[j]], len(a_of(a[i])), len(b_of(b[j]))
                    i, j = i + 1, j + 1
                    while ea != eb:
                        if ea < eb:
                            ga.append(a[i])
                            ea += len(a_of(a[i]))
                            i += 1
                        else:
                            gb.append(b[j])
                            eb += len(b_of(b[j]))
                            j += 1
                    groups.append((ga, gb))
        linked = Counter((x, y) for ga, gb in groups for x in ga for y in gb)
        held.update(linked.keys())
        docs.append((groups, linked))
    top = defaultdict(int)
    for (x, _), n in held.items():
        top[x] = max(top[x], n)
    out = []
    for i, (groups, linked) in enumerate(docs):
        text = ";".join(",".join(map(str, ga)) + "|" + ",".join(map(str, gb)) for ga, gb in groups)
        out.append((i, sum(len(g[0]) for g in groups), sum(len(g[1]) for g in groups), len(groups), sum(linked.values()),
                    sum(n for k, n in linked.items() if held[k] == top[k[0]]), sum(n * held[k] for k, n in linked.items()),
                    hashlib.sha256(text.encode()).hexdigest() if groups else ""))
    return out, held


def alignment_texts(spark):
    rng = random.Random(6)
    real = [r.text for r in spark.read.parquet("/root/testdata/sf0.001/documents.parquet").orderBy("doc_id").limit(60).collect()]
    odd = ["<|endoftext|> and <s> </s> <unk>", "a▁b", "  double  blanks   and\ttabs\n\n", "ﬁ ﬂ ½ ™ é", "日本語のテキスト 漢字",
           "🙂🙃 🇩🇪", " " * 300, "a" * 500, "  x", "\x00\x01", "<0x41>A<0x0A>", "x" + "́" * 40]
    mixed = ["".join(rng.choice(["the ", "ing", "é", "日", "\n", " ", "1", "__", "<", "Ω"]) for _ in range(rng.randint(1, 60))) for _ in range(40)]
    return real + ODD + odd + mixed + [real[0], real[0]]


@pytest.mark.parametrize("limit,piece", [(align.BROADCAST_PAIRS, 1 << 21), (0, 3)])
def test_alignment_is_brute_force(spark, monkeypatch, limit, piece):
    texts = alignment_texts(spark)
    want, held = plain_alignment(texts)
    docs = documents(spark, texts, clash=True)
    if limit:
        got = align.digests(docs, FILES, broadcast_pairs=limit)
    else:
        got = align.digests(docs, FILES, broadcast_pairs=limit)
    assert sorted(tuple(r) for r in got.collect()) == want
    p = align.pair(FILES)
    monkeypatch.setattr(align, "_SLICE", piece)
    a, b = p.encode(["x" + "́" * 40, "日本語のテキスト 漢字"])
    for x, y in zip(a, b):  # small slices give the same counts
        one = lambda v: np.array([len(v)])
        k, n = align._irregular(x, y, one(x), one(y), np.array([0]), np.array([0]))
        plain = Counter((int(i) << 16) | int(j) for i in x for j in y)
        assert dict(zip(k.tolist(), n.tolist())) == plain


def test_alignment_dictionary(spark):
    texts = alignment_texts(spark)
    _, held = plain_alignment(texts)
    got = align.dictionary(align.links(documents(spark, texts), FILES), FILES).collect()
    assert {(r.a_id, r.b_id): r.n_docs for r in got} == held and any(r.best for r in got)


def test_alignment_agrees_with_the_tokenizer_files(spark):
    from tokenizers import Tokenizer
    t = Tokenizer.from_file(FILES[0])
    t.encode_special_tokens = True
    p = align.pair(FILES)
    for text in alignment_texts(spark):
        if text:
            assert t.encode(" " + text, add_special_tokens=False).ids == p.encode_a(" " + text).tolist()
    blanks = "a" + " " * 1_000_000 + "b"
    assert t.encode(" " + blanks, add_special_tokens=False).ids == p.encode_a(" " + blanks).tolist()


def test_alignment_odd_tables(spark):
    assert align.digests(rows_of(spark, []), FILES).collect() == []
    docs = rows_of(spark, [(None, "the same", "en", "s", 0)] * 3 + [(1, None, None, None, None)])
    got = sorted((tuple(r) for r in align.digests(docs, FILES).collect()), key=str)
    assert got[0] == (1, 0, 0, 0, 0, 0, 0, "") and len(got) == 4 and got[1] == got[2] == got[3] and got[1][6] == 6
