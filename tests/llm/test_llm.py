"""Operators against brute force, and edge cases: nulls, empty and long texts, ties, repeated rows, clashing columns, empty tables."""

import base64
import hashlib
import re
from collections import Counter

import numpy as np
import pytest
from oracle import spark_rows, sql_rows

from foliant.llm import bpe, chat, common, exact_dedup, katz, line_dedup, media, packing, quality, queries, simhash, suffix_dedup
from foliant.session import table

SHAPE = "doc_id long, text string, row int, score string, key int"
LONG = " ".join(f"word{i % 977}" for i in range(9000))
ODD = [(1, None, 1, "a", 1), (2, "", 1, "a", 1), (3, " \t\n", 1, None, 1), (4, "one two three", 1, "a", 1), (4, "one two three", 1, "a", 1), (None, "one  two three", 1, "a", 1), (6, LONG, 1, "a", 1), (7, LONG + " end", 1, "a", 1), (8, "é" * 6000, None, "a", 1), (9, "word " * 200, 1, "a", None)]


@pytest.fixture(scope="module")
def odd(spark):
    return spark.createDataFrame(ODD, SHAPE)


@pytest.fixture(scope="module")
def docs(spark, sf_dir):
    return table(spark, sf_dir, "documents")


def components(n, linked):
    parent = list(range(n))

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for i, j in linked:
        parent[find(i)] = find(j)
    return [find(i) for i in range(n)]


def test_bpe_is_tiktoken(docs, odd):
    import tiktoken

    path, pattern = bpe.vocabulary()
    ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, open(path, "rb"))}
    lib = tiktoken.Encoding("own", pat_str=pattern, mergeable_ranks=ranks, special_tokens={})
    for df in (docs, odd):
        text = sorted((r["text"] or "" for r in df.select("text").collect()))
        want = sorted((len(i := lib.encode_ordinary(t)), hashlib.sha256(",".join(map(str, i)).encode()).hexdigest(), hashlib.sha256(t.encode()).hexdigest()) for t in text)
        assert sorted((r[1], r[2], r[3]) for r in bpe.digests(df, path, pattern).collect()) == want
    back = bpe.decode(bpe.encode(odd, path, pattern), path, pattern).collect()
    assert sorted(r["text"] for r in back) == sorted(r[1] or "" for r in ODD)


def test_word_ids_are_the_library_s():
    tok = packing.load(packing.vocabulary())
    texts = [r[1] or "" for r in ODD] + ["ΑΣ ΣΑΣ", "İ ſ K Å é", "<|endoftext|> hi", "it's 's'S 12a3!!", "\x85a\xa0b", "あ😀 x", "a" * 3000]
    assert [np.frombuffer(x, "<u4").tolist() for x in tok.ids_of_many(texts)] == [tok.tokenizer.encode(t, add_special_tokens=False).ids for t in texts]


def check_packing(rows, n_docs):
    by_seq, by_doc = {}, {}
    for r in rows:
        by_seq.setdefault(r["sequence_id"], []).append((r["offset"], r["length"]))
        by_doc.setdefault((r["doc_id"], r["doc_tokens"]), []).append((r["start"], r["length"]))
    for parts in by_seq.values():
        at = 0
        for offset, length in sorted(parts):
            assert offset == at
            at += length
        assert at <= 2048
    assert sum(r["length"] for r in rows) == sum(r["doc_tokens"] for r in rows if r["start"] == 0) and sum(r["start"] == 0 for r in rows) == n_docs


def test_packing(docs, odd):
    check_packing(packing.pack_documents(docs, packing.vocabulary()).collect(), docs.count())
    check_packing(packing.pack_documents(odd, packing.vocabulary()).collect(), len(ODD))
    assert dict(packing.shortest_pack_first({5: 2, 3: 3, 2: 1}, 8)) == {(5, 3): 2, (3, 2): 1}


def test_exact_and_chat_match_sql(spark, sf_dir):
    for name in ("op7_exact_dedup", "op10_chat"):
        assert spark_rows(queries.queries()[name](spark, sf_dir)) == sql_rows(queries.oracle_sql()[name], sf_dir)


def test_exact_edges(odd):
    got = exact_dedup.digests(odd).collect()
    assert Counter(r["group_size"] for r in got) == {3: 6, 1: 4} and sum(r["kept"] for r in got) == 6
    # Most code points, then smallest doc_id: white space counts for which row stays.
    assert {r["keep_id"] for r in got if r["doc_id"] in (1, 2, 3)} == {3} and [r["keep_id"] for r in got if r["doc_id"] == 4] == [None, None]


def test_simhash(docs, odd):
    for df in (docs, odd):
        got = simhash.digests(df).collect()
        fp = [int(r["fingerprint"], 16) for r in got]
        comp = components(len(fp), [(i, j) for i in range(len(fp)) for j in range(i) if (fp[i] ^ fp[j]).bit_count() <= 4])
        least = {}
        for c, r in zip(comp, got):
            if r["doc_id"] is not None:
                least[c] = min(least.get(c, r["doc_id"]), r["doc_id"])
        assert [r["component_id"] for r in got] == [least[c] for c in comp]


def test_bk_tree_finds_all():
    draw = np.random.default_rng(1)
    base = draw.integers(0, 2**63, 6)
    values = list(dict.fromkeys(int(b) ^ int(np.bitwise_or.reduce(1 << draw.integers(0, 60, 3))) for b in base for _ in range(60)))
    groups = sorted(sorted(g) for g in simhash.BkTree(values).groups(4))
    comp = components(len(values), [(i, j) for i in range(len(values)) for j in range(i) if (values[i] ^ values[j]).bit_count() <= 4])
    want = {}
    for v, c in zip(values, comp):
        want.setdefault(c, []).append(v)
    assert groups == sorted(sorted(g) for g in want.values() if len(g) > 1)


def windows(rows):
    places = {}
    for n, (doc, text) in enumerate(rows):
        w = (text or "").encode().split()
        for k in range(len(w) - 49):
            places.setdefault(tuple(w[k : k + 50]), []).append((doc is None, doc or 0, n, k))
    drop, keep = Counter(), Counter()
    for p in places.values():
        if len(p) > 1:
            for x in p:
                (keep if x == min(p) else drop).update({(x[1], x[2], i): 1 for i in range(x[3], x[3] + 50)})
    return set(drop), set(keep)


def test_suffix_spans(spark, docs, odd):
    for df in (docs, odd.coalesce(1)):
        rows = common.numbered(df, common.Scratch(spark, "test"))
        texts = [(r["doc_id"], r["text"]) for r in rows.select("doc_id", "text").collect()]
        number = {r["__foliant_row"]: n for n, r in enumerate(rows.select("__foliant_row").collect())}
        got = suffix_dedup.repeated_spans(rows).collect()
        cover = lambda first: {(r["doc_id"] or 0, number[r["row"]], i) for r in got if r["is_first"] == first for i in range(r["start_word"], r["end_word"])}
        assert (cover(False), cover(True)) == windows(texts)
    left = suffix_dedup.without_repeats(odd.coalesce(1))
    assert left.columns == odd.columns and left.count() == len(ODD)
    assert suffix_dedup.cut("a b  c d", [(1, 3)]) == "a d"


def distance(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        last, row[0] = row[0], i
        for j, y in enumerate(b, 1):
            last, row[j] = row[j], min(row[j] + 1, row[j - 1] + 1, last + (x != y))
    return row[-1]


def test_fuzzy_lines(spark, odd):
    base = "the quick brown fox jumps over the lazy dog near the river bank while the old miller counts forty sacks of barley flour by candle light and hums a tune of the northern hills that his mother sang"
    rows = [(i, f"{base} {x}\nother line {i}\n{base}") for i, x in enumerate(["", "now", "then", "NOW", "soon again"])] + [(9, None), (9, "other line 1")]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    got = {(r["doc_id"], r["line_no"]): (r["keep_doc_id"], r["keep_line_no"]) for r in line_dedup.line_groups(df).collect()}
    places = {}
    for d, t in rows:
        for k, x in enumerate((t or "").lower().split("\n")):
            if x := re.sub(r"\s+", " ", x).strip():
                places.setdefault(x, []).append((d, k))
    names = list(places)
    near = [(i, j) for i in range(len(names)) for j in range(i) if distance(names[i], names[j]) <= int(max(len(names[i]), len(names[j])) * 0.2 + 1e-9)]
    assert near
    groups = {}
    for x, c in zip(names, components(len(names), near)):
        groups.setdefault(c, []).extend(places[x])
    assert got == {p: min(g) for g in groups.values() if len(g) > 1 for p in g}
    assert line_dedup.line_groups(odd).count() == 5  # three equal lines, and two long ones that differ by a word


def similar_lines(names):
    """All pairs with edit similarity of at least 0.8, found without fingerprints; character counts only spare hopeless distances."""
    counts = [Counter(x) for x in names]
    for i, x in enumerate(names):
        for j in range(i):
            room = int(max(len(x), len(names[j])) * 0.2 + 1e-9)
            if abs(len(x) - len(names[j])) <= room and sum(((counts[i] - counts[j]) + (counts[j] - counts[i])).values()) <= 2 * room and distance(x, names[j]) <= room:
                yield i, j


def test_fuzzy_lines_are_all_similar_ones(spark, docs):
    normal = lambda x: re.sub(r"[\s!-/:-@\[-`{-~]+", " ", x.lower()).strip()
    lines = sorted({x for r in docs.select("text").collect() for x in (r["text"] or "").split("\n") if 0 < len(normal(x)) <= 100})[:300]
    draw = np.random.default_rng(7)
    altered = []
    for x in lines[::2]:
        words = x.split()
        words[draw.integers(len(words))] = "zebra"
        altered += [" ".join(words), ", ".join(x.split())]
    rows = list(enumerate([*lines, *altered]))
    got = {r["doc_id"]: r["keep_doc_id"] for r in line_dedup.line_groups(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    first = {}
    for d, x in rows:
        first.setdefault(normal(x), []).append(d)
    names = list(first)
    pairs = list(similar_lines(names))
    short = [p for p in pairs if len(names[p[0]].split()) < 8]
    together = lambda some: np.mean([first[names[i]][0] in got and got[first[names[i]][0]] == got.get(first[names[j]][0]) for i, j in some])
    assert len(pairs) > 80 and len(short) > 10
    assert together(pairs) >= 0.95 and together(short) >= 0.9
    truth = dict(zip(names, components(len(names), pairs)))
    assert all(truth[normal(rows[d][1])] == truth[normal(rows[k][1])] for d, k in got.items())
    assert all(len({got.get(d) for d in same}) == 1 and None not in {got.get(d) for d in same} for same in first.values() if len(same) > 1)


def test_lines_that_differ_by_punctuation_are_equal(spark):
    rows = [(1, "one, two: three!"), (2, "One two three"), (3, "(one)  two -- three."), (4, "... !")]
    got = line_dedup.line_groups(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert sorted((r["doc_id"], r["keep_doc_id"]) for r in got) == [(1, 1), (2, 1), (3, 1)]


def test_katz_is_normalised_and_exact(spark, docs):
    small = docs.filter("doc_id < 60").select("doc_id", "text").unionByName(spark.createDataFrame([(1000, None), (1001, "")], "doc_id long, text string"))
    got = {r["doc_id"]: r for r in katz.score_documents(small).collect()}
    import zlib

    rows = [(r["doc_id"], (r["text"] or "").encode().lower().split() + [0]) for r in small.collect()]
    train = [w for d, w in rows if zlib.crc32(str(d).encode()) % 10]
    uni, bi = Counter(x for w in train for x in w), Counter(p for w in train for p in zip([1] + w, w))
    hist = Counter(h for w in train for h in [1] + w[:-1])
    of = lambda c: [0] + [sum(v == r for v in c.values()) for r in range(1, 7)]
    du, db = katz.discounts(of(uni)), katz.discounts(of(bi))
    n = sum(uni.values())
    seen_u = {w: du[min(c, 6)] * c for w, c in uni.items()}
    rest = n - sum(seen_u.values())
    p1 = lambda w: seen_u.get(w, rest) / n
    follow = {}
    for (h, w), c in bi.items():
        follow.setdefault(h, {})[w] = c
    alpha, den = {}, {}
    for h, f in follow.items():
        left = hist[h] - sum(db[min(c, 6)] * c for c in f.values())
        bare = left <= 1e-9 * hist[h]
        den[h] = hist[h] + bare
        alpha[h] = ((1 if bare else left) / den[h]) / (1 - sum(p1(w) for w in f))
    p2 = lambda h, w: db[min(follow[h][w], 6)] * follow[h][w] / den[h] if w in follow.get(h, {}) else alpha.get(h, 1.0) * p1(w)
    for h in list(follow)[:20]:
        assert abs(sum(p2(h, w) for w in [*uni, "unknown"]) - 1) < 1e-9
    for d, w in rows:
        assert got[d]["n_tokens"] == len(w) and got[d]["train_tokens"] == n and got[d]["n_known"] == sum(x in uni for x in w)
        assert abs(got[d]["score"] - sum(np.log10(p2(h, x)) for h, x in zip([1] + w, w))) < 1e-6
        assert abs(got[d]["base_score"] - sum(np.log10((uni[x] + 0.1) / (n + 0.1 * (len(uni) + 1))) for x in w)) < 1e-6


def test_katz_keeps_good_turing_on_copies():
    of = [0, 5000, 1600, 800, 420, 700, 260]  # copies that occur five times: d_4 is over 1 by the counts as they are
    assert 5 * of[5] > 4 * of[4]
    z = np.log([of[r] for r in range(1, 7)])
    slope, level = np.polyfit(np.log(np.arange(1, 7)), z, 1)
    n = np.exp(level + slope * np.log(np.arange(1, 7)))
    top = 6 * n[5] / n[0]
    want = [((r + 1) * n[r] / (r * n[r - 1]) - top) / (1 - top) for r in range(1, 6)]
    for kind in ("word_d", "pair_d"):
        model = katz.Model({"tokens": 99999, "types": 9999, "of": of}, {"tokens": 99999, "types": 9999, "of": of})
        assert np.allclose(getattr(model, kind)[1:6], want) and getattr(model, kind)[6] == 1
    assert all(0 < a < b < 1 for a, b in zip(want, want[1:]))
    good = [0, 6000, 1500, 700, 420, 290, 210]
    top = 6 * good[6] / good[1]
    assert np.allclose(katz.discounts(good)[1:6], [((r + 1) * good[r + 1] / (r * good[r]) - top) / (1 - top) for r in range(1, 6)])


def test_quality_held_out(spark, odd):
    sf = "/root/testdata/sf0.01"
    labels = table(spark, sf, "labels")
    model = quality.fit(table(spark, sf, "documents"), labels, teaches=quality.teaching_rows())
    held = quality.score(table(spark, sf, "documents"), model).join(labels, "doc_id").filter("held_out").toPandas()
    good, bad = held.score[held.quality == 1].values, held.score[held.quality == 0].values
    assert np.mean(good[:, None] > bad[None]) > 0.95
    assert quality.score(odd, model).filter("score between 0 and 1").count() == len(ODD)
    none = quality.fit(odd, labels.limit(0))
    assert {r["score"] for r in quality.score(odd, none).collect()} == {0.5}


def test_media(odd):
    draw = np.random.default_rng(3)
    for codec in media.CODECS:
        for n in (64, 256, 64 * 37):
            body = draw.integers(0, 256, n, np.uint8).tobytes()
            kind, rate, block, data = media.parse(media.store(body, codec))
            assert (kind, rate, media.payload_of(kind, block, data)) == (codec, media.RATE, body)
    blocks = draw.integers(0, 256, (5, 36), np.uint8)
    pcm = media.ima_decode(blocks)
    for block, row in zip(blocks, pcm):  # one sample after the other
        value, index = int(block[:2].view("<i2")[0]), min(int(block[2]), 88)
        want = [value]
        for byte in block[4:].tolist():
            for code in (byte & 15, byte >> 4):
                step = int(media.STEPS[index])
                delta = (step >> 3) + (step if code & 4 else 0) + (step >> 1 if code & 2 else 0) + (step >> 2 if code & 1 else 0)
                value = max(-32768, min(32767, value - delta if code & 8 else value + delta))
                index = max(0, min(88, index + int(media.INDEX_STEP[code])))
                want.append(value)
        assert row.tolist() == want
    assert media.resample(np.array([0, 10, 20], np.int16), 8000, 16000).tolist() == [0, 5, 10, 15, 20, 20]
    assert sorted(set(media.TABLES["mulaw"].tolist()))[-1] == 32124 and media.TABLES["alaw"][0xAA] == 32256
    got = {r["doc_id"]: r for r in media.digests(odd.filter("doc_id is not null")).collect()}
    assert got[1]["payload_bytes"] == 64 and got[1]["media_sha256"] == got[2]["media_sha256"] and got[6]["payload_sha256"] == hashlib.sha256(media.payload(LONG.encode())).hexdigest()


def test_chat_edges(spark):
    rows = [(1, 0, "user", None), (1, 1, "user", "&lt;|x<|im_sep|>\n"), (1, 2, "assistant", "a"), (1, 3, "assistant", ""), (1, 3, "assistant", ""), (None, None, None, "x"), (2, 70, "a\nb&nl;", "q"), (2, 3, "assistant", "<|im_end|>\n")]
    got = {r["conv_id"]: r for r in chat.read_back(chat.conversations_as_text(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string"))).collect()}
    turns = lambda k: [tuple(t) for t in got[k]["turns"]]
    assert turns(1) == [("user", ""), ("user", rows[1][3]), ("assistant", "a"), ("assistant", ""), ("assistant", "")]
    assert turns(None) == [("", "x")] and turns(2) == [("assistant", "<|im_end|>\n"), ("a\nb&nl;", "q")]
    assert [got[1]["formatted"][m["start"] : m["start"] + m["length"]] for m in got[1]["mask"]] == ["a", "", ""]


def test_pipeline_near_stage_is_jaccard(spark, sf_dir):
    import corpus_pipeline

    docs = corpus_pipeline.drop_exact_copies(spark, table(spark, "/root/testdata/sf0.01", "documents").select("doc_id", "text"), sf_dir)
    draw = np.random.default_rng(11)
    texts = [(r["doc_id"], r["text"]) for r in docs.collect()]
    # Altered copies of varied similarity; copies and unlike texts that share an id or have none.
    for k, (_, t) in enumerate([x for x in texts if 40 < len((x[1] or "").split()) < 400][:120]):
        words = t.split()
        for _ in range(1 + k % 4):
            words[draw.integers(len(words))] = f"altered{k}"
        texts.append((None if k % 3 else 5, " ".join(words)))
    texts = list(dict.fromkeys(texts))
    df = spark.createDataFrame(texts, "doc_id long, text string").coalesce(1)
    path = "/tmp/checkpoints/foliant/test-near-input"
    df.write.mode("overwrite").parquet(path)
    df = spark.read.parquet(path)
    rows = [(r["doc_id"], r["text"]) for r in df.collect()]
    sets = [{tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))} if (w := (t or "").encode().lower().split()) else set() for _, t in rows]
    holds = {}
    for i, s in enumerate(sets):
        for x in s:
            holds.setdefault(x, []).append(i)
    common = Counter((i, j) for same in holds.values() for j in same for i in same if i < j)
    pairs = [(i, j) for (i, j), n in common.items() if n >= 0.8 * (len(sets[i]) + len(sets[j]) - n) - 1e-9]
    assert len(pairs) > 40
    groups = {}
    for i, c in enumerate(components(len(rows), pairs)):
        groups.setdefault(c, []).append(i)
    order = lambda i: (rows[i][0] is not None, rows[i][0] or 0, i)
    want = Counter(rows[min(g, key=order)] for g in groups.values())
    got = Counter((r["doc_id"], r["text"]) for r in corpus_pipeline.drop_near_copies(spark, df, sf_dir).collect())
    assert got == want


def test_empty_tables(spark, odd):
    none = odd.limit(0)
    for f in (lambda d: bpe.digests(d, *bpe.vocabulary()), media.digests, simhash.digests, exact_dedup.digests, suffix_dedup.spans_query, line_dedup.line_groups, katz.score_documents, lambda d: packing.pack_documents(d, packing.vocabulary())):
        assert f(none).count() == 0


def test_pipeline(spark, sf_dir):
    import corpus_pipeline

    docs = table(spark, sf_dir, "documents")
    before = docs.count()
    for name, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, docs, sf_dir)
        assert out.columns == docs.columns
        path = f"/tmp/checkpoints/foliant/test-{name}"
        out.write.mode("overwrite").parquet(path)
        docs = spark.read.parquet(path)
        assert 0 < docs.count() <= before
    assert suffix_dedup.spans_query(docs).filter("not kept").count() <= 3  # joins of what was cut may rarely repeat
    check_packing(corpus_pipeline.STAGES[-1][1](spark, docs, sf_dir).collect(), docs.count())
