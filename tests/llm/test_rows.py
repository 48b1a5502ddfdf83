"""Edge rows, round trips and held-out accuracy of the other text operators, and the pipeline's stages."""

import hashlib
import zlib

import corpus_pipeline
import numpy as np
import public_tokenizers
import pytest
from barloom.llm import exact, html_crf, jaccard, mixing, mpeg, packing, quality
from barloom.llm.wordbpe import WordBpe

SF = "/root/testdata/sf0.001"
BPE = public_tokenizers.path("word_bpe_49k.json")
ODD = [(1, "Abc def", "a"), (2, "aBC DEF", "b"), (2, "aBC DEF", "b"), (3, None, None), (4, "", "a"), (None, "abc def", None), (None, None, "b"), (5, "Éa", "b"), (6, "éa", "b"), (7, "word " * 40000, "a")]


@pytest.fixture(scope="module")
def odd(spark):
    return spark.createDataFrame([(*r, 1, "x", 2.0) for r in ODD], "doc_id long, text string, source string, _id int, keep_id string, size double").repartition(3)


def low(text):
    return "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")


def test_exact_groups(odd):
    rows = exact.exact_groups(odd).collect()
    assert len(rows) == len(ODD)
    for r in rows:
        same = [i for i, t, _ in ODD if hashlib.sha256(low(t).encode()).hexdigest() == r.text_sha256]
        ids = [i for i in same if i is not None]
        assert r.group_size == len(same) and r.keep_id == max(ids, default=None) and r.kept == (r.doc_id == r.keep_id)
    kept = exact.keep_rows(odd)
    assert kept.columns == odd.columns and len({low(r.text) for r in kept.collect()}) == kept.count() == len({low(t) for _, t, _ in ODD})


def test_mixing(odd):
    rows = mixing.mix(odd).collect()
    assert len(rows) == len(ODD) and all(0 <= r.taken <= 2 * r["size"] for r in rows)
    copies = {}
    for r in mixing.mix_rows(odd).collect():
        copies[r.doc_id] = copies.get(r.doc_id, 0) + 1
    assert set(copies) <= {i for i, _, _ in ODD}


def test_mixing_meets_targets(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    of = {r.doc_id: r.source for r in docs.collect()}
    taken, target, largest = {}, {}, {}
    for r in mixing.mix(docs).collect():
        s = of[r.doc_id]
        taken[s], target[s], largest[s] = taken.get(s, 0) + r.taken, r.target, max(largest.get(s, 0), r["size"])
    assert all(abs(taken[s] - target[s]) <= largest[s] for s in taken)


def test_mpeg_round_trip(odd):
    rows = mpeg.stored_text(odd).collect()
    assert len(rows) == len(ODD)
    for text in ["", "a", "ÿû" * 3000, "\xff\xfb" * 900, "x" * 64, "x" * 65]:
        n, payload = mpeg.padded(text)
        media = mpeg.store_payload(payload)
        index = mpeg.index_stream(media)
        assert mpeg.read_payload(media, index) == payload and len(payload) % 64 == 0 and len(payload) >= max(64, n)
        assert index["crc_bad"] == 0 and index["junk"] == 0 and index["table"][1] == len(index["offsets"]) and index["table"][2] == len(media) - mpeg._id3v2(media)[0]
    by = {r.doc_id: r for r in rows if r.doc_id}
    assert by[1].n_bytes == 7 and by[4].payload_bytes == 64 and by[4].payload_sha256 == hashlib.sha256(bytes(64)).hexdigest() and by[4].tail_crc32 == zlib.crc32(bytes(64))


def test_mpeg_resynchronises_and_sees_damage(spark):
    media = mpeg.store_payload(bytes(range(256)) * 20)
    frames = mpeg.index_stream(media)["offsets"]
    broken = bytearray(media)
    broken[frames[1] + 8] ^= 1  # side information
    index = mpeg.index_stream(b"junk\xff\xfbjunk" + media[mpeg._id3v2(media)[0] :] + b"TAGname" + bytes(121))
    assert len(index["offsets"]) == len(frames) and index["junk"] == 10 and index["tags"]["TIT2"] == "name"
    assert mpeg.index_stream(bytes(broken))["crc_bad"] == 1
    df = spark.createDataFrame([(1, bytearray(media), "x"), (2, None, "y"), (3, bytearray(b""), None)], "id int, media binary, tags string")
    rows = {r.id: r.media_index for r in mpeg.media_index(df, "media").collect()}
    assert rows[1].frames == len(frames) and rows[1].seek_offsets == frames and rows[1].duration_us == len(frames) * 36_000 and rows[2].frames == rows[3].duration_us == 0


def test_word_bpe_equals_the_library():
    rng, bpe = np.random.default_rng(0), WordBpe(BPE)
    letters = list("aAbBéÉßΣσς İI'sdtrevml0½²ªº9_-!?.\t\n\x1c\u0301 \u00a0\u3000漢字あ한🙂ﬁ")
    texts = ["".join(rng.choice(letters, rng.integers(0, 60))) for _ in range(800)] + ["", "x" * 500, "don't I'LL we've"]
    want = [np.array(e.ids, "<u4").tobytes() for e in bpe.library.encode_batch(texts, add_special_tokens=False)]
    assert list(bpe.encode(texts)) == want
    letters = list("aBbÉé's,.!_#(- \n12")
    texts = ["".join(rng.choice(letters, rng.integers(0, 60))) for _ in range(800)] + ["nul\x00. x\x7f. y", "A" * 300 + ".", "«a». ñ¿ ²!", "!" * 200_000 + "a"]
    assert list(bpe.encode(texts)) == [np.array(e.ids, "<u4").tobytes() for e in bpe.library.encode_batch(texts, add_special_tokens=False)]


def check_pieces(rows, docs, window):
    bpe, ids = WordBpe(BPE), {}
    for (i, t), x in zip(docs, bpe.encode([t for _, t in docs]), strict=True):
        ids.setdefault(i, x + (2).to_bytes(4, "little"))
    by_doc, by_seq = {}, {}
    for r in rows:
        assert r.ids_crc32 == zlib.crc32(ids[r.doc_id][4 * r.start : 4 * (r.start + r.length)]) and r.doc_tokens == len(ids[r.doc_id]) // 4
        by_doc.setdefault(r.doc_id, []).append((r.start, r.length))
        by_seq.setdefault(r.sequence_id, []).append((r.offset, r.length))
    for i, pieces in by_doc.items():
        n = sum(d == i for d, _ in docs)
        assert sum(x for _, x in pieces) == n * len(ids[i]) // 4
    for pieces in by_seq.values():
        end = 0
        for offset, length in sorted(pieces):
            assert offset == end
            end += length
        assert end <= window
    return sum(r.length for r in rows) / (window * len(by_seq))


def test_packing(spark, odd):
    check_pieces(packing.pack(odd.filter("doc_id is not null"), BPE, window=256, open_windows=4).collect(), [(i, t) for i, t, _ in ODD if i is not None], 256)
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    assert check_pieces(packing.pack(docs, BPE).collect(), [(r.doc_id, r.text) for r in docs.collect()], 4096) > 0.95


def test_quality_held_out(spark, odd):
    docs, labels = (spark.read.parquet(f"/root/testdata/sf0.1/{t}.parquet") for t in ("documents", "labels"))
    rows = quality.score(docs, labels).join(labels, "doc_id").filter("held_out").collect()
    poor = [r for r in rows if r.quality == 0]
    assert sum(r.predicted == r.quality for r in rows) / len(rows) > 0.98 and sum(r.predicted == 0 for r in poor) / len(poor) > 0.93
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 3 == 1) for r in rows)
    scores = quality.score(odd, labels).collect()
    assert len(scores) == len(ODD) and all(0 <= r.score <= 1 and r.predicted == int(r.score >= 0.5) for r in scores)
    assert all(r.score == 0.5 for r in quality.score(odd, labels.limit(0)).collect())


PAGES = [
    ("<nav><a>Home</a></nav><article><h1>A &amp; B</h1><p>One  <b>bo</b>ld\n text, and some more of it; the end.<p>Two.</article><footer>f</footer>", "A & B One bold text, and some more of it; the end. Two."),
    (None, ""), ("", ""), ("<script>var a = '<p>no</p>';</script><!-- <p>no</p> -->", ""),
]


def test_html(spark):
    pages = spark.read.parquet(f"{SF}/pages.parquet")
    model = html_crf.fit(pages)
    df = spark.createDataFrame([(i, None, p, "x") for i, (p, _) in enumerate(PAGES)] + [(None, "u", "<p>" * 3000, "y")], "page_id long, url string, html string, text string")
    got = {r.page_id: r for r in html_crf.extract(df, model=model).collect()}
    assert {i: got[i].text for i in range(len(PAGES))} == {i: t for i, (_, t) in enumerate(PAGES)} and got[0].n_chars == len(PAGES[0][1])
    assert html_crf.extract(pages.limit(0)).count() == 0
    for r in html_crf.extract(pages, model=model).join(pages, "page_id").collect():
        found, y = html_crf.self_labelled(r.html)
        assert r.text == " ".join(t for (t, _, _), keep in zip(found, y, strict=True) if keep)


def test_html_layouts_held_out():
    """Each layout decoded by a model that has not seen it."""
    known, wrong, total = html_crf.labelled_pages(), 0, 0
    for i in range(0, len(known), 4):
        model = html_crf.train([(html_crf.features(f), y) for f, y in known[:i] + known[i + 4 :]], steps=40)
        for f, y in known[i : i + 4]:
            wrong += sum(a != bool(b) for a, b in zip(html_crf.viterbi(html_crf.features(f), model), y, strict=True))
            total += len(y)
    assert wrong / total < 0.15


def test_empty_documents(spark):
    none = spark.createDataFrame([], "doc_id long, text string, source string, lang string, n_chars long")
    labels = spark.createDataFrame([], "doc_id long, quality int")
    assert [x.count() for x in (exact.exact_groups(none), exact.keep_rows(none), mixing.mix(none), mixing.mix_rows(none), mpeg.stored_text(none), packing.pack(none, BPE), quality.score(none, labels), quality.keep_good(none, labels))] == [0] * 8


def test_pipeline_stages(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    good = corpus_pipeline.good_documents(spark, docs, SF)
    scores = quality.score(docs, spark.read.parquet(f"{SF}/labels.parquet"))
    assert good.columns == docs.columns and {r.doc_id for r in good.collect()} == {r.doc_id for r in scores.filter("predicted = 1").collect()}
    once = corpus_pipeline.one_of_equals(spark, good, SF)
    best = {}
    for r in good.collect():
        best[low(r.text)] = max(best.get(low(r.text), -1), r.doc_id)
    assert once.columns == docs.columns and sorted(r.doc_id for r in once.collect()) == sorted(best.values())
    near = corpus_pipeline.one_of_near_copies(spark, once, SF)
    assert near.columns == docs.columns and {r.doc_id for r in near.collect()} == {r.component_id for r in jaccard.join(once).collect()}
    mix = corpus_pipeline.mixed(spark, near, SF)
    copies = {r.doc_id: r.copies for r in mixing.mix(near).collect() if r.copies}
    rows = mix.collect()
    assert mix.columns == docs.columns and {i: sum(r.doc_id == i for r in rows) for i in {r.doc_id for r in rows}} == copies
    check_pieces(corpus_pipeline.packed(spark, mix, SF).collect(), [(r.doc_id, r.text) for r in rows], 4096)
