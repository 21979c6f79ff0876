"""Decontamination, pieces, WARC and the classifiers against brute force, libraries and held-out labels."""

from __future__ import annotations

import base64
import hashlib
import math
import random
import re
from collections import Counter, defaultdict

import numpy as np
import public_tokenizers
import pytest
import sentencepiece
from pyspark.sql import functions as F

from tagloom.llm import decontaminate, language, pieces, quality, queries, samples, toxicity, warc
from tagloom.llm.common import table

SF = "/root/testdata/sf0.01"
MODEL = public_tokenizers.path("piece_bpe_32k.model")


def words(text):
    lower = re.sub("[A-Z]", lambda m: m.group().lower(), text or "")
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", lower)


def brute_contamination(rows, items):
    windows = defaultdict(set)
    for item, text in items:
        w = words(text)
        for k in range(max(len(w) - 9, min(len(w), 1))):
            windows[tuple(w[k : k + 10])].add(str(item))
    expected = Counter()
    for i, text in rows:
        w, hit, found = words(text), set(), set()
        for n in {len(x) for x in windows}:
            for k in range(len(w) - n + 1):
                owners = windows.get(tuple(w[k : k + n]))
                if owners:
                    hit.update(range(k, k + n))
                    found |= owners
        ids = hashlib.sha256(",".join(sorted(found)).encode()).hexdigest()
        expected[(i, len(w), len(hit), len(found), ids, bool(hit))] += 1
    return expected


@pytest.mark.parametrize("block", [decontaminate.BLOCK_BYTES, 200])
def test_decontamination(spark, docs, rows, no_docs, block, monkeypatch):
    texts = [t for _, t in rows if t]
    items = [(1, " ".join(texts[0].split()[3:20])), (2, texts[1].upper()), (10, "x"), (11, ""), (12, None)]
    items += [(13, "é日本🦆 ß"), (1, " ".join(texts[5].split()[:11])), (14, "no such words in any of the documents at all")]
    bench = spark.createDataFrame(items, "item_id long, text string")
    found = decontaminate.contamination(docs.select("doc_id", "text"), bench, block).select(
        "doc_id", "_n_words", F.size("_hit"), F.size("_items"), F.sha2(F.array_join("_items", ","), 256), F.size("_hit") > 0
    )
    assert Counter(tuple(r) for r in found.collect()) == brute_contamination(rows, items)
    kept = decontaminate.decontaminate(docs, bench)
    assert kept.columns == docs.columns and 0 < kept.count() < docs.count()
    assert decontaminate.decontaminate(no_docs, bench).count() == 0
    assert decontaminate.decontaminate(docs, bench.filter("false")).count() == docs.count()


@pytest.fixture(scope="module")
def library():
    return sentencepiece.SentencePieceProcessor(model_file=MODEL)


def test_pieces_of_the_table(spark, library):
    texts = {r.doc_id: r.text for r in table(spark, SF, "documents").collect()}
    for r in queries.op9_pieces(spark, SF).collect():
        ids = library.encode(texts[r.doc_id], add_bos=True, add_eos=True)
        assert r.n_tokens == len(ids)
        assert r.ids_sha256 == hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest()
        assert r.decoded_sha256 == hashlib.sha256(library.decode(ids).encode()).hexdigest()


def test_pieces_edges(docs, rows, no_docs, library):
    expected = Counter()
    for i, t in rows:
        ids = library.encode(t or "", add_bos=True, add_eos=True)
        expected[(i, len(ids), hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest(), hashlib.sha256(library.decode(ids).encode()).hexdigest())] += 1
    assert Counter(tuple(r) for r in pieces.token_digests(docs, MODEL).collect()) == expected
    assert pieces.token_digests(no_docs, MODEL).count() == 0


def test_random_text_encodes_as_the_library(library):
    encoder = pieces.PrefixEncoder(pieces.read_vocabulary(MODEL), chunk_bytes=9000)
    rng = random.Random(4)
    for alphabet in ("aeiou nst▁.,\n0159éß日🦆-_=/<>\0\t", "the and ing ", "aaab  ", "()[]{};=+-*/ \n"):
        for _ in range(1500):
            text = "".join(rng.choice(alphabet) for _ in range(rng.randint(0, 50)))
            ids = encoder.encode(text)
            expected = library.encode(text, add_bos=True, add_eos=True)
            assert np.frombuffer(ids, "<u4").tolist() == expected, text
            assert encoder.decode(ids).decode() == library.decode(expected), text


def test_warc_round_trip(spark, tmp_path):
    html = ["<p>a</p>", "", None, "<p>a</p>", "é" * 3000, "<p>a</p>", "", "x" * 9000]
    data = [(10 - i, f"http://h/{i}\r\nX: y" if i else None, h, "z") for i, h in enumerate(html)]
    data.append((None, "u", "<p>a</p>", "z"))
    pages = spark.createDataFrame(data, "page_id long, url string, html string, _sha1 string")
    folder = str(tmp_path / "warc")
    catalogue = warc.write_archives(pages, folder, frame_bytes=4000)
    found = {r.page_id: r for r in warc.read_archives(catalogue, folder, payloads=True).collect()}
    assert len(found) == len(data)
    for page_id, _, h, _ in data:
        body = (h or "").encode()
        same = [p for p, _, x, _ in data if (x or "") == (h or "") and p is not None]
        r = found[None if page_id is None else str(page_id)]
        assert r.payload_bytes == len(body)
        assert r.payload_digest == base64.b32encode(hashlib.sha1(body).digest()).decode()
        if page_id == min(same):
            assert (r.record_type, r.refers_to) == ("response", None) and bytes(r.payload) == body
        else:
            assert (r.record_type, r.refers_to) == ("revisit", str(min(same)))
    for r in catalogue.collect():  # any record alone, by its frame and offset
        frame = warc.ArchiveReader(folder, r.archive).read(r.frame)
        assert f"WARC-Record-ID: {r.record_id}".encode() in frame[r.offset : r.offset + r.length]
    assert warc.archive_report(pages.filter("false")).count() == 0


def test_ids_of_any_text(spark, tmp_path):
    ids = ["", "a b", "x\r\nWARC-Type: revisit", "é:%41", None, "0"]
    pages = spark.createDataFrame([(i, "u", h) for i in ids for h in ("same", f"own {i}")], "page_id string, url string, html string")
    folder = str(tmp_path / "warc")
    found = warc.read_archives(warc.write_archives(pages, folder), folder).collect()
    assert Counter(r.page_id for r in found) == Counter(ids * 2)
    assert {r.refers_to for r in found if r.record_type == "revisit"} == {min(i for i in ids if i is not None)}


def test_archives_are_one_zstandard_stream(spark, tmp_path):
    import zstandard

    folder = str(tmp_path / "warc")
    pages = spark.createDataFrame([(i, "u", "h" * i) for i in range(50)], "page_id long, url string, html string")
    warc.write_archives(pages, folder, frame_bytes=2000).count()
    total = 0
    for path in (tmp_path / "warc").glob("*.warc.zst"):
        with path.open("rb") as f:
            total += zstandard.ZstdDecompressor().stream_reader(f, read_across_frames=True).read().count(b"WARC/1.1\r\n")
    assert total == 50


def brute_bits(grams: dict[bytes, int], text: bytes, order: int) -> float:
    """Code length by its definition: byte by byte, context by context."""
    counts: dict[bytes, Counter] = defaultdict(Counter)
    for gram, n in grams.items():
        for k in range(order + 1):
            counts[gram[order - k : order]][gram[order]] += n
    padded, bits = bytes(order) + text, 0.0
    for at in range(order, len(padded)):
        for k in range(order, -1, -1):
            seen = counts.get(padded[at - k : at])
            if seen:
                whole = sum(seen.values()) + len(seen)
                if padded[at] in seen:
                    bits += math.log2(whole / seen[padded[at]])
                    break
                bits += math.log2(whole / len(seen))
        else:
            bits += 8
    return bits


def test_code_lengths():
    train = {"a": b"abracadabra abra cadabra banana", "b": "çebu dedi ébé dada".encode()}
    lang, gram, n = [], [], []
    for k, text in enumerate(train.values()):
        g, c = np.unique(language.pack(text, language.ORDER), return_counts=True)
        lang += [k] * len(g)
        gram += g.tolist()
        n += c.tolist()
    model = language.Model(list(train), np.array(lang), np.array(gram), np.array(n))
    rng = random.Random(1)
    texts = [b"abra", b"cadabra zebu", "çébé".encode(), b"dedi dada banana", b"", b"\x00\xff unseen ZZZ"]
    texts += [bytes(rng.choice(b"abcdeu \xc3\xa9z") for _ in range(rng.randint(1, 60))) for _ in range(200)]
    for text in texts:  # contexts that no language saw are among them
        bits = model.code_lengths(text)
        for k in range(2):
            grams = {int(g).to_bytes(4, "big"): c for l, g, c in zip(lang, gram, n) if l == k}
            assert bits[k] == pytest.approx(brute_bits(grams, text, language.ORDER), abs=1e-3)


def held_out_rates(report, truth, label):
    rows = report.filter("held_out").join(truth, "doc_id").select("predicted", label).collect()
    hits = Counter((r[0], r[1]) for r in rows)
    return hits[(1, 1)] / max(1, hits[(1, 1)] + hits[(0, 1)]), hits[(0, 0)] / max(1, hits[(0, 0)] + hits[(1, 0)])


def test_language_accuracy(spark):
    docs_ = table(spark, SF, "documents")
    found = queries.op1_language(spark, SF).join(docs_.select("doc_id", "lang"), "doc_id")
    rate = found.filter("held_out").agg(F.avg((F.col("lang_pred") == F.col("lang")).cast("int"))).head()[0]
    assert rate > 0.98
    assert found.filter("score < 0 or score > 1 or score is null").count() == 0


def test_language_edges(docs, no_docs, rows):
    found = Counter(r.lang_pred for r in language.language_report(docs).collect())
    assert found["und"] == sum(not re.search(r"[^\W\d_]", t or "") for _, t in rows)
    assert language.language_report(no_docs).count() == 0


def test_quality_and_toxicity_held_out(spark):
    # About 1000 held-out rows: of the toxic labels some stand on texts without any toxic word.
    sf = "/root/testdata/sf0.1"
    labels = table(spark, sf, "labels")
    recall, clean = held_out_rates(queries.op2_quality(spark, sf), labels, "quality")
    assert recall > 0.99 and clean > 0.95
    recall, clean = held_out_rates(queries.op7_toxicity(spark, sf), labels, "toxic")
    assert recall > 0.9 and clean > 0.98


@pytest.mark.parametrize("report", [quality.quality_report, toxicity.toxicity_report])
def test_classifier_edges(spark, docs, no_docs, report):
    label = "quality int, toxic int"
    labels = spark.createDataFrame([(i, i % 2, i % 3 % 2) for i in range(25)] + [(None, 1, 1), (3, None, None)], f"doc_id long, {label}")
    found = report(docs, labels)
    assert found.count() == docs.count()
    assert found.filter("score is null or score < 0 or score > 1 or predicted not in (0, 1)").count() == 0
    assert report(no_docs, labels).count() == 0
    assert report(docs, labels.filter("false")).count() == docs.count()


def test_hash_share_below_a_millionth(spark):
    ids = spark.range(20_000_000).withColumnRenamed("id", "doc_id")
    assert 2 <= ids.filter(samples.hash_share(5e-7)).count() <= 25
    assert ids.limit(1000).filter(samples.hash_share(1.0)).count() == 1000


def test_lexicon_counts_different_documents(spark):
    rng = random.Random(4)
    prose = lambda: [f"w{chr(97 + rng.randint(0, 25))}{chr(97 + rng.randint(0, 25))}" for _ in range(60)]
    copied = prose()
    rows = [(" ".join(prose() + "you utter grunkle head".split() + prose()), 1) for _ in range(40)]
    rows += [(" ".join(copied + "such a zibble here".split() + copied + [f"t{i}"]), 1) for i in range(40)]
    rows += [(" ".join(prose() + prose()), 0) for _ in range(200)]
    docs = spark.createDataFrame([(i, t) for i, (t, _) in enumerate(rows)], "doc_id long, text string")
    labels = spark.createDataFrame([(i, y) for i, (_, y) in enumerate(rows)], "doc_id long, toxic int")
    weights = toxicity.learn(docs, labels).weights
    assert "grunkle" in weights and "zibble" not in weights


def test_folding_and_exceptions():
    assert toxicity.fold("ІDI0T m0r0n cl@ss") == "idiot moron class"
    lexicon = toxicity.Lexicon({"trash": 3.0, "scum": 4.0}, ["trash can"])
    assert lexicon.matches("a TR4SH can, pond sсum, trashy")[0] == 4.0
    assert lexicon.matches("trash trash can")[0] == 3.0
    assert lexicon.matches("")[0] == 0.0


def test_ranking_orders_pairs():
    rng = np.random.default_rng(1)
    x = rng.normal(size=(400, 3))
    good = x[:, 1] + 0.1 * rng.normal(size=400) > -0.8
    ranking = quality.fit_ranking(x, good)
    score = ranking.score(x)
    assert score[good].min() > np.quantile(score[~good], 0.5)
    assert abs((score >= quality.ACCEPT).mean() - good.mean()) < 0.01
