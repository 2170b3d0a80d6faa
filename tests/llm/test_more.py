"""Second computations of the classifier, of packing and of media columns; stages on odd tables; numbers that change between scans."""

import hashlib
import random
import zlib
from collections import Counter

import numpy as np
import pytest
from foliant.llm import chat, line_dedup, media, packing, quality
from foliant.llm.common import Scratch
from foliant.session import table


def test_quality_model_is_the_dual_optimum():
    draw = np.random.default_rng(12)
    words = [[f"good{i}" for i in range(9)], [f"bad{i}" for i in range(9)]]
    texts = [" ".join(draw.choice(words[int(draw.random() < 0.2) ^ (k % 2)], 12)).encode() for k in range(40)]
    y = np.array([1 - k % 2 for k in range(40)])
    sets = quality.Features().sets(texts)
    grams = lambda t: {("c", t[i : i + 3]) for i in range(len(t) - 2)} | {("w", *w) for n in (1, 2) for w in zip(*(t.split()[k:] for k in range(n)))}
    assert all(len(s) <= len(grams(t)) <= len(s) + 3 for s, t in zip(sets, texts))  # but for the few that share a slot
    ratios = quality.log_count_ratios(sets, y)
    total = [sum(len(s) + 0 for s, v in zip(sets, y) if v == c) + 2 * quality.SLOTS for c in (0, 1)]
    for f in set(sets[0][:20].tolist()):
        share = [(1 + sum(f in s for s, v in zip(sets, y) if v == c)) / total[c] for c in (0, 1)]
        assert ratios[f] == pytest.approx(np.log(share[1] / share[0]))
    w, b = quality.dual_descent(sets, y, ratios, 1.0, 2000)
    x = np.zeros((40, len(ratios)))
    for i, s in enumerate(sets):
        x[i, s] = ratios[s] / np.sqrt(len(s))
    sign = 2.0 * y - 1
    q = (x @ x.T + 1) * np.outer(sign, sign)
    alpha, step = np.zeros(40), 1 / np.linalg.eigvalsh(q)[-1]
    for _ in range(20000):  # projected gradient of the same dual
        alpha = np.clip(alpha + step * (1 - q @ alpha), 0, 1)
    want = (x @ x.T + 1) @ (alpha * sign)
    got = np.array([w[s].sum() / np.sqrt(len(s)) + b for s in sets])
    assert np.allclose(got, want, atol=2e-2)
    a, c = quality.logistic(want, y)
    t = np.where(y == 1, (y.sum() + 1) / (y.sum() + 2), 1 / ((1 - y).sum() + 2))
    p = 1 / (1 + np.exp(-(a * want + c)))
    assert a > 0 and abs((p - t).sum()) < 1e-3 and abs((p - t) @ want) < 1e-2
    margins = quality.Features().margins(texts, w.astype(np.float32), b)
    assert np.allclose(margins, got, atol=1e-3)
    long = b" ".join(f"w{i}".encode() for i in range(5000))
    few, quality.FEW_FEATURES = quality.FEW_FEATURES, 10**9
    sorted_one = quality.Features().margins([long], w.astype(np.float32), b)
    quality.FEW_FEATURES = few
    assert np.allclose(sorted_one, quality.Features().margins([long], w.astype(np.float32), b), atol=1e-4)


def test_packing_over_documents(spark, sf_dir):
    docs = table(spark, sf_dir, "documents")
    tok = packing.load(packing.vocabulary())
    rows = packing.pack_documents(docs, packing.vocabulary()).collect()
    ids = {r["doc_id"]: tok.tokenizer.encode(r["text"] or "", add_special_tokens=False).ids + [1] for r in docs.select("doc_id", "text").collect()}
    seen = Counter()
    for r in rows:
        part = ids[r["doc_id"]][r["start"] : r["start"] + r["length"]]
        assert len(part) == r["length"] and r["doc_tokens"] == len(ids[r["doc_id"]]) and r["ids_crc32"] == zlib.crc32(np.array(part, "<u4").tobytes())
        seen[r["doc_id"]] += r["length"]
    assert seen == {d: len(i) for d, i in ids.items()}
    sequences = {}
    for r in rows:
        sequences.setdefault(r["sequence_id"], []).append((r["offset"], r["length"]))
    for parts in sequences.values():
        at = 0
        for offset, length in sorted(parts):
            assert offset == at
            at += length
        assert at <= 2048
    total = sum(map(len, ids.values()))
    assert len(sequences) <= -(-total // 2048) * 1.02 + 1


def test_common_lengths_are_dealt_out(spark, monkeypatch):
    monkeypatch.setattr(packing, "RANKED", 7)
    docs = spark.createDataFrame([(i, "a") for i in range(60)] + [(100, None), (None, "")], "doc_id long, text string")
    rows = packing.pack_documents(docs, packing.vocabulary(), 8).collect()
    assert len(rows) == 62 and len({(r["sequence_id"], r["offset"]) for r in rows}) == 62
    assert all(r["offset"] + r["length"] <= 8 for r in rows)


def test_media_columns_are_stored_and_read(spark, sf_dir, tmp_path):
    docs = table(spark, sf_dir, "documents").select("doc_id", "text").limit(60).unionByName(spark.createDataFrame([(-1, None), (-2, ""), (-3, "x" * 64), (-4, "é" * 33)], "doc_id long, text string")).cache()
    text = {r.doc_id: (r.text or "").encode() for r in docs.collect()}
    media.encode_media(docs).write.parquet(str(tmp_path / "media"))
    stored = {r.doc_id: r for r in spark.read.parquet(str(tmp_path / "media")).collect()}
    assert stored.keys() == text.keys()
    got = {r.doc_id: r for r in media.digests(docs).collect()}
    assert got.keys() == text.keys()
    for d, t in text.items():
        body = t + b"\0" * (64 if not t else -len(t) % 64)
        r, s = got[d], stored[d]
        assert (r.n_bytes, r.payload_bytes, r.payload_sha256, r.tail_crc32) == (len(t), len(body), hashlib.sha256(body).hexdigest(), zlib.crc32(body[-64:]))
        assert (r.media_bytes, r.media_sha256, s.n_bytes) == (len(s.media), hashlib.sha256(s.media).hexdigest(), len(t))
        kind, rate, block, data = media.parse(bytes(s.media))
        assert media.payload_of(kind, block, data) == body
        pcm = np.frombuffer(bytes(s.pcm), "<i2")
        plain = media.pcm_of_many([(kind, rate, block, data)])[0].astype(np.int64)
        up = media.STORED_RATE // rate
        want = [plain[n // up] if n // up + 1 >= len(plain) else plain[n // up] + (plain[n // up + 1] - plain[n // up]) * (n % up) // up for n in range(len(plain) * up)]
        assert pcm.tolist() == want and r.feature == media.feature(pcm, kind) and r.feature.startswith(f"{kind};n={len(pcm)};")
    assert media.encode_media(docs.limit(0)).count() == 0
    docs.unpersist()


def test_resampling_at_other_rates():
    x = np.array([0, 100, -50, 7], np.int16)
    for rate, to in ((8000, 16000), (8000, 44100), (16000, 8000), (11025, 8000), (8000, 8000)):
        n = len(x) * to // rate
        want = []
        for k in range(n):
            at, part = divmod(k * rate, to)
            a = int(x[min(at, 3)])
            b = int(x[min(at + 1, 3)])
            g = np.gcd(rate, to)
            want.append(a + (b - a) * (part // g) // (to // g))
        assert media.resample(x, rate, to).tolist() == want


def test_long_conversation(spark):
    turns = [(1, i, ("user", "assistant")[i % 3 == 1], f"t{i}<|im_end|>") for i in range(1500)]
    df = spark.createDataFrame(turns, "conv_id long, turn long, role string, text string")
    got = chat.read_back(chat.conversations_as_text(df)).first()
    assert [tuple(t) for t in got["turns"]] == [(r, t) for _, _, r, t in turns]
    learned = [t for _, _, r, t in turns if r == "assistant"]
    assert [got["formatted"][m["start"] : m["start"] + m["length"]].replace("&lt;", "<") for m in got["mask"]] == learned
    assert chat.digests(df.limit(0)).count() == 0


CLASHING = "doc_id long, text string, n_chars long, row int, key int, id int, line string, score string"
ODD = [(1, None, 0, 1, 1, 1, "a", "x"), (2, "", 0, 1, 1, 1, None, "x"), (2, "", 0, 1, 1, 1, None, "x"), (None, " \n\t", 3, None, None, None, None, None), (5, "one line\nanother line\none line", 30, 1, 1, 1, "a", "x"), (6, "word " * 3000, 15000, 1, 1, 1, "a", "x"), (7, "word " * 3000 + "end", 15003, 1, 1, 1, "a", "x")]


def test_stages_on_odd_tables(spark, sf_dir):
    import corpus_pipeline

    odd = spark.createDataFrame(ODD, CLASHING)
    for docs in (odd, odd.limit(0)):
        n = docs.count()
        for name, stage in corpus_pipeline.STAGES:
            out = stage(spark, docs, sf_dir)
            rows = out.collect()
            if name == "packing":
                assert n == 0 or sum(r["length"] for r in rows) > 0
            else:
                assert out.columns == docs.columns and len(rows) <= n
            if name == "exact" and n:
                assert len(rows) == 4  # the empty texts and the blank one are one, by row, whatever their ids
    without = line_dedup.without_repeats(odd.filter("doc_id is not null").dropDuplicates(["doc_id"]))
    assert without.columns == odd.columns and {r.doc_id: r.text for r in without.collect()}[5] == "one line\nanother line"
    assert quality.score(odd.limit(0), quality.fit(odd, table(spark, sf_dir, "labels"))).count() == 0


def test_numbers_do_not_depend_on_the_scan(spark, tmp_path):
    import corpus_pipeline

    base = [" ".join(f"w{(i * 7 + k) % 5003}" for k in range(60)) for i in range(300)]
    rows = [(i, base[i % 300]) for i in range(600)]
    path = str(tmp_path / "docs")
    spark.createDataFrame(rows, "doc_id long, text string").repartition(7).write.parquet(path)
    before = spark.conf.get("spark.sql.files.minPartitionNum", None)
    try:
        spark.conf.set("spark.sql.files.minPartitionNum", "2")
        out = corpus_pipeline.drop_exact_copies(spark, spark.read.parquet(path), "")
        spark.conf.set("spark.sql.files.minPartitionNum", "23")
        assert sorted(r.doc_id for r in out.collect()) == list(range(300))
    finally:
        spark.conf.unset("spark.sql.files.minPartitionNum") if before is None else spark.conf.set("spark.sql.files.minPartitionNum", before)


def test_lines_find_similar_ones_of_documents(spark):
    """Recall against all pairs of lines by edit similarity alone, over lines of documents up to 400 characters."""
    import re

    docs = table(spark, "/root/testdata/sf0.01", "documents").select("doc_id", "text")
    got = {(r.doc_id, r.line_no): (r.keep_doc_id, r.keep_line_no) for r in line_dedup.line_groups(docs).collect()}
    first = {}
    for d, t in sorted((r.doc_id, r.text or "") for r in docs.collect()):
        for k, x in enumerate(t.lower().split("\n")):
            if (x := re.sub(r"[\s!-/:-@\[-`{-~]+", " ", x).strip()) and len(x) <= 400:
                first.setdefault(x, (d, k))
    names = list(first)
    letters = np.array([np.bincount(np.frombuffer(x.encode("utf-32-le"), np.uint32) % 97, minlength=97) for x in names], np.int16)
    size = np.array(list(map(len, names)))
    draw = np.random.default_rng(9)
    pairs = []
    for i in draw.permutation(len(names))[:1500]:
        room = np.floor(np.maximum(size, size[i]) * 0.2 + 1e-9)
        near = np.flatnonzero((np.abs(letters - letters[i]).sum(axis=1) <= 2 * room) & (np.abs(size - size[i]) <= room))
        pairs += [(names[i], names[j]) for j in near if j != i]
    df = spark.createDataFrame(sorted(set(pairs)), "a string, b string").repartition(8)
    similar = df.filter("levenshtein(a, b) <= floor(greatest(length(a), length(b)) * 0.2 + 1e-9)").collect()
    together = [first[r.a] in got and got[first[r.a]] == got.get(first[r.b]) for r in similar]
    assert len(together) > 40
    print("recall", np.mean(together), len(together))
    assert np.mean(together) >= 0.9


def test_near_copies_that_are_not_alike_hardly_make_pairs(spark, monkeypatch):
    """Sketches keep each pair of sets of similarity 0.8, and few pairs of a large group whose members are less alike."""
    from foliant.llm import near_dedup

    draw = np.random.default_rng(3)
    for _ in range(1500):
        x = draw.integers(0, 2**64, 270, np.uint64)
        a, b = (near_dedup.sketch(s).view(np.uint64) for s in (x[:243], x[27:]))
        assert int(np.bitwise_count(a ^ b).sum()) <= near_dedup.DIFFER
    words = [f"word{k}" for k in range(300)]
    copies = []
    for k in range(60):
        copy = words[:]
        for i in draw.choice(300, 10, replace=False):
            copy[i] = f"other{k}x{i}"
        copies.append((k, " ".join(copy)))
    made, verify = [], near_dedup.verify
    monkeypatch.setattr(near_dedup, "verify", lambda pairs, *a: (made.append(pairs.distinct().count()), verify(pairs, *a))[1])
    assert near_dedup.near_copies(spark.createDataFrame(copies, "doc_id long, text string")).count() == 0
    assert sum(made) <= 250, made


def test_lines_with_an_edit_in_every_word_are_linked(spark):
    """Similar lines that share no word, and short ones of a word or two."""
    long = "catalogue reviewer northern standard building mountain shoulder language feathers distance keyboard question triangle umbrella vineyard"
    lines = [long, " ".join(w[:3] + "z" + w[4:] for w in long.split()), "abcdef", "abcdez", "ab cdef", "entirely different words", "abcd", "abce", "x" * 100, "x" * 80 + "y", "x" * 80]
    got = {r.doc_id: r.keep_doc_id for r in line_dedup.line_groups(spark.createDataFrame(list(enumerate(lines)), "doc_id long, text string")).collect()}
    assert got == {0: 0, 1: 0, 2: 2, 3: 2, 4: 2, 8: 8, 9: 8, 10: 8}


def test_lines_that_keys_leave_are_compared_without_copies(spark):
    """What the last comparison shuffles is a few times its lines, not one copy of them for each part of a band."""
    rng = random.Random(3)
    lines = ["".join(rng.choices("abcdefghijklmnopqrstuvwxyz0123456789 ", k=rng.randint(60, 90))) for _ in range(1200)]
    lines += ["#" + x[1:40] + "#" + x[41:] for x in lines[:50]] + ["ab", "abcdefghij", "abcdefghiz", "x" * 100, "x" * 80, "x" * 79]
    df = spark.createDataFrame(list(enumerate(lines)), "id long, line string").localCheckpoint()
    known = spark.createDataFrame([(5, 5), (1205, 5)], "node long, component long")
    jvm = spark.sparkContext._jvm
    stages = lambda: spark.sparkContext._jsc.sc().statusStore().stageList(None, False, False, spark.sparkContext._gateway.new_array(jvm.double, 0), jvm.java.util.ArrayList())
    written = lambda: sum(s.shuffleWriteBytes() for s in (x.apply(i) for x in [stages()] for i in range(x.size())))
    spark.sparkContext._jsc.sc().listenerBus().waitUntilEmpty(30_000)
    before = written()
    got = {(min(r), max(r)) for r in line_dedup.rest_links(df, known, 0.8, Scratch(spark, "rest-test"), "rest").collect()}
    spark.sparkContext._jsc.sc().listenerBus().waitUntilEmpty(30_000)
    assert got == {(i, 1200 + i) for i in range(50) if i != 5} | {(1251, 1252), (1253, 1254), (1254, 1255)}
    assert 0 < written() - before < 6 * sum(map(len, lines))
