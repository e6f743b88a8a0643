import hashlib
import math
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest

from ferrovia.llm import components, gru, iblt, jpeg, langid, licenses, mixing, mjpeg, packing, queries, ranges, sharding, textvec, warc

SF = "/root/testdata/sf0.001"
WORD = re.compile(r"[^\x20\x09-\x0D]+")
ODD = [
    (1, "One two three", "a"), (2, None, "a"), (3, "", None), (None, "nobody's text", "b"), (5, "x " * 30_000, "a"), (6, "y" * 50_000, None),
    (7, "One two three", "a"), (7, "One two three", "a"), (8, "über 日本語 \U0001f600", "c"), (None, None, None), (9, " \t\n", "d"),
]


@pytest.fixture(scope="module")
def docs(spark):
    return spark.read.parquet(f"{SF}/documents.parquet")


#: Names that the operators and stages use themselves.
CLASH = (
    "size", "shard", "record", "language", "lang_pred", "score", "spans", "mix", "copies", "copy", "target", "taken", "of", "salt", "own", "source_size", "digest", "gone", "rows",
    "again", "bucket", "at", "slot", "same", "key", "n", "set_id", "component_id", "n_shingles", "held_out", "ids", "start", "sequence_id", "text_key", "w", "media", "clips", "range",
)


@pytest.fixture(scope="module")
def odd(spark):
    rows = [(d, t, s, "en", *range(len(CLASH))) for d, t, s in ODD]
    return spark.createDataFrame(rows, "doc_id long, text string, source string, lang string, " + ", ".join(f"`{c}` int" for c in CLASH)).repartition(3)


@pytest.fixture(scope="module")
def none(odd):
    return odd.where("false")


def n_words(text):
    return len(WORD.findall(text or ""))


def lower(text):
    return (text or "").translate(str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"))


# 1 mixing


def filled(sizes, weights=(5, 2, 1), total=1.5, cap=2.0):
    """Targets by sharing the excess again and again."""
    names = sorted(sizes, key=lambda s: (s is None, s or ""))
    weight = {s: weights[i % 3] for i, s in enumerate(names)}
    target, left, open_ = {}, total * sum(sizes.values()), set(names)
    while open_:
        level = left / sum(weight[s] for s in open_)
        over = {s for s in open_ if level * weight[s] > cap * sizes[s]}
        for s in over or open_:
            target[s] = cap * sizes[s] if over else level * weight[s]
        left -= sum(target[s] for s in over)
        open_ -= over or open_
    return target


def test_targets_and_taken_words(spark, docs):
    rows = queries.op1_source_mixing(spark, SF).collect()
    again = {r.doc_id: r.taken for r in queries.op1_source_mixing(spark, SF).collect()}
    source = {r.doc_id: r.source for r in docs.collect()}
    sizes = Counter()
    for r in rows:
        sizes[source[r.doc_id]] += r.size
    wanted, taken = filled(sizes), Counter()
    for r in rows:
        assert r.source_size == sizes[source[r.doc_id]] and math.isclose(r.target, wanted[source[r.doc_id]])
        assert 0 <= r.taken <= 2 * r.size and r.taken == again[r.doc_id]
        taken[source[r.doc_id]] += r.taken
    assert abs(sum(taken.values()) / sum(wanted.values()) - 1) < 0.1


def test_mixing_odd_rows(odd, none):
    rows = mixing.with_copies(odd).collect()
    assert len(rows) == len(ODD) and all(r.record[c] == i for r in rows for i, c in enumerate(CLASH))
    assert Counter(r.mix["size"] for r in rows) == Counter(n_words(t) for _, t, _ in ODD)
    mixed = mixing.mix(odd)
    assert mixed.columns == odd.columns and mixed.count() == sum(r.mix["copies"] for r in rows)
    assert all(r[c] == i for r in mixed.collect() for i, c in enumerate(CLASH))
    assert mixing.mix(none).count() == 0


def test_mixing_without_broadcast(odd, monkeypatch):
    wanted = sorted(map(str, mixing.with_copies(odd).collect()))
    monkeypatch.setattr(mixing, "BROADCAST_SOURCES", 0)
    assert sorted(map(str, mixing.with_copies(odd).collect())) == wanted


# 2 archives


def test_warc_round_trip(spark, tmp_path):
    long = "<p>" + "long " * 40_000
    rows = [(1, "http://a/%41 b", "same"), (2, None, "same"), (3, "u\r\nX: y", None), (4, "http://é/", ""), (5, "v", long), (5, "v", long), (None, "w", "same"), (6, "x", "é" * 9), (None, "y", "lone")]
    pages = spark.createDataFrame([(*r, 0, "z") for r in rows], "page_id long, url string, html string, refers_to int, digest string")
    folder = f"file://{tmp_path}/one"
    manifest = warc.write_warc(pages, folder, roll_bytes=600, range_bytes=60_000).collect()
    got = warc.read_warc(spark, folder).collect()
    assert sum(m.records for m in manifest) == len(rows) == len(got) and len(manifest) > 1
    seen = Counter((r.page_id, r.url, r.record_type, r.refers_to) for r in got)
    assert seen == Counter([(1, "http://a/%41 b", "revisit", 2), (2, None, "response", None), (3, "u\r\nX: y", "revisit", 4), (4, "http://é/", "response", None), (5, "v", "response", None), (5, "v", "revisit", 5), (None, "w", "revisit", 2), (6, "x", "response", None), (None, "y", "response", None)])
    for r in got:
        assert r.payload is None or (len(r.payload) == r.payload_bytes and warc.base32_sha1(bytes(r.payload)) == r.payload_digest)
    twice = warc.write_warc(pages.repartition(4), f"file://{tmp_path}/two", roll_bytes=600, range_bytes=60_000).collect()
    assert sorted(manifest) == sorted(twice)
    small = warc.round_trip(pages, min_revisit_bytes=5).where("record_type = 'revisit'").collect()
    assert [r.page_id for r in small] == [5]
    assert warc.round_trip(pages.where("false")).count() == 0


def test_archives_depend_on_the_records_alone(spark, tmp_path):
    pages = spark.read.parquet("/root/testdata/sf0.1/pages.parquet")
    extra = spark.range(300).selectExpr("CAST(null AS BIGINT) AS page_id", "concat('u', id) AS url", "repeat(CAST(id % 7 AS STRING), 2000) AS html")
    pages = pages.select("page_id", "url", "html").union(extra)
    found = []
    for i, frame in enumerate((pages, pages.repartition(13, "url"), pages.orderBy("html"))):
        found.append(sorted(warc.write_warc(frame, f"file://{tmp_path}/{i}", range_bytes=1 << 20, roll_bytes=1 << 18).collect()))
    assert found[0] == found[1] == found[2] and len({m.file.split("-")[1] for m in found[0]}) > 5
    assert sum(m.records for m in found[0]) == pages.count()
    folder = f"file://{tmp_path}/0"
    with pytest.raises(Exception, match="already exists|PATH_ALREADY_EXISTS"):
        warc.write_warc(pages, folder, range_bytes=1 << 20, roll_bytes=1 << 18)
    assert not list((tmp_path / "0" / "_temporary").iterdir())  # what was there stayed, what was written again went


def test_ranges_of_many_equal_keys(spark):
    rows = spark.range(20_000).selectExpr("CASE WHEN id % 3 = 0 THEN 7 WHEN id % 3 = 1 THEN null ELSE id - 10000 END AS number", "hex(id % 50) AS rest")
    keyed = rows.select("number", "rest", ranges.sort_key(rows.number, rows.rest).alias("key"), ranges.sort_key(rows.number, rows.rest, descending=True).alias("back"))
    for key, order in (("key", lambda r: (r.number is not None, r.number or 0, r.rest)), ("back", lambda r: (r.number is None, -(r.number or 0), r.rest))):
        firsts = ranges.first_keys(keyed.selectExpr(f"{key} AS key", "1 AS size"), 20_000, 20_000, 500)
        assert firsts == sorted(set(firsts)) and 15 < len(firsts) < 40
        got = sorted(keyed.withColumn("range", ranges.range_of(keyed[key], firsts)).collect(), key=order)
        numbers = [r.range for r in got]
        assert numbers == sorted(numbers) and set(numbers) == set(range(len(firsts) + 1))
        assert max(Counter(numbers).values()) < 1500


# 4 sharding


def test_shards(spark, docs):
    rows = queries.op4_external_shuffle(spark, SF).collect()
    text = {r.doc_id: r.text for r in docs.collect()}
    slots = defaultdict(list)
    for r in rows:
        data = text[r.doc_id].encode()
        assert (r.size, r.text_crc32) == (len(data) + 16, zlib.crc32(data)) and r.grown_shard in (r.shard, 40)
        slots[r.shard].append(r.slot)
    assert len(rows) == len(text) and all(sorted(x) == list(range(len(x))) for x in slots.values())
    assert rows and sorted(rows) == sorted(queries.op4_external_shuffle(spark, SF).collect())


def test_shards_of_odd_rows(odd, none):
    rows = sharding.shuffled_shards(odd, shards=3, bucket_bytes=4000).collect()
    assert Counter((r.record.doc_id, r.record.text) for r in rows) == Counter((d, t) for d, t, _ in ODD)
    slots = defaultdict(list)
    for r in rows:
        slots[r.shard].append(r.slot)
    assert all(sorted(x) == list(range(len(x))) for x in slots.values())
    assert sharding.shuffled_shards(none, shards=3).count() == 0
    assert all(r.record[c] == i for r in rows for i, c in enumerate(CLASH))


def test_key_law(spark):
    """The shard of the largest hash, as Spark has it for each pair of id and shard."""
    rows = queries.op4_external_shuffle(spark, SF).collect()
    hashes = spark.createDataFrame([(r.doc_id,) for r in rows], "doc_id long").crossJoin(spark.range(41).selectExpr("CAST(id AS INT) AS s"))
    by_doc = defaultdict(dict)
    for r in hashes.selectExpr("doc_id", "s", "xxhash64(20260101, doc_id, s) AS h").collect():
        by_doc[r.doc_id][r.s] = r.h
    for r in rows:
        h = by_doc[r.doc_id]
        assert r.shard == max(range(40), key=h.get) and r.grown_shard == max(range(41), key=h.get)
    moved = [r for r in rows if r.shard != r.grown_shard]
    assert len({r.shard for r in rows}) > 30 and 0 < len(moved) < len(rows) / 10


def test_equal_rows_are_spread(spark):
    rows = [(1, "same text", 5)] * 3000 + [(None, f"text {i}", i) for i in range(1000)] + [(i, "other", 0) for i in range(500)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, copy int").repartition(5)
    found = sharding.shuffled_shards(docs, shards=4, bucket_bytes=6000)
    got = found.collect()
    assert Counter(tuple(r.record) for r in got) == Counter(rows)
    slots = defaultdict(list)
    for r in got:
        slots[r.shard].append(r.slot)
    assert all(sorted(x) == list(range(len(x))) for x in slots.values())
    ordered = sorted((r for r in got if r.record.doc_id == 1), key=lambda r: r.slot)
    assert max(r.slot for r in ordered) - min(r.slot for r in ordered) >= 3000 or len({r.shard for r in ordered}) == 1
    again = sharding.shuffled_shards(docs.repartition(3), shards=4, bucket_bytes=6000).collect()
    assert sorted(map(str, again)) == sorted(map(str, got))


# 5 packing


def test_both_files_give_the_same_ids(docs):
    a, b = (packing.encoder(public_tokenizers.path(f"byte_bpe_50k.{x}")) for x in ("json", "tiktoken"))
    for text in [r.text for r in docs.collect()] + [t or "" for _, t, _ in ODD] + ["a<|endoftext|>b", "don't  we'll\n\n\tI'M ‍　 1234567"]:
        assert list(a(text)) == list(b(text))


def test_ids_are_those_of_the_tokenizer_as_loaded(docs):
    from tokenizers import Tokenizer

    tokenizer = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    assert {t.content: i for i, t in tokenizer.get_added_tokens_decoder().items()} == packing.SPECIAL
    encode = packing.encoder(public_tokenizers.path("byte_bpe_50k.tiktoken"))
    assert list(encode("a<|endoftext|>b")) == [64, 50256, 65]
    odd = ["<|endoftext|>", "x <|endoftext|> <|endoftext|><|endoftext|>\n y", "  <|endoftext|>  \n", "<|endoftext", "<|ENDOFTEXT|>", "<|end<|endoftext|>oftext|>", " 12<|endoftext|>'s", "", "\x00 \ufeff\u0301"]
    for text in [r.text for r in docs.collect()] + [t or "" for _, t, _ in ODD] + odd:
        assert list(encode(text)) == tokenizer.encode(text, add_special_tokens=False).ids


@pytest.mark.parametrize("group", [1 << 21, 3000])
def test_pieces(docs, odd, group):
    path = public_tokenizers.path("byte_bpe_50k.tiktoken")
    encode = packing.encoder(path)
    for frame in (docs, odd):
        pieces = packing.pack(frame, path, group_tokens=group).collect()
        by_doc, by_sequence = defaultdict(list), defaultdict(list)
        for p in pieces:
            ids = np.frombuffer(bytes(p.ids), "<u4")
            assert len(ids) == p.length > 0
            by_doc[p.doc_id].append((p.start, ids.tolist(), p.doc_tokens))
            by_sequence[p.sequence_id].append((p.offset, p.length))
        for x in by_sequence.values():
            at = 0
            for offset, length in sorted(x):
                assert offset == at
                at += length
            assert at <= 2048
        whole = defaultdict(list)
        for r in frame.collect():
            whole[r.doc_id].append([*encode(r.text or ""), 1])
        assert set(whole) == set(by_doc)
        for d, wanted in whole.items():
            if len(wanted) == 1:
                assert [i for x in sorted(by_doc[d]) for i in x[1]] == wanted[0] and all(x[2] == len(wanted[0]) for x in by_doc[d])
            assert sum(len(x[1]) for x in by_doc[d]) == sum(map(len, wanted))


def test_assignment_is_balanced_and_tight():
    r = np.random.default_rng(1)
    lengths = r.integers(1, 2048, 500).tolist()
    out = packing.assign(lengths, 2048, 1.0, 1 / 2048)
    used, cost = Counter(), Counter()
    for _, _, length, s, _ in out:
        used[s] += length
        cost[s] += length + length * length / 2048
    assert len(used) == -(-sum(lengths) // 2048) and max(used.values()) <= 2048
    assert max(cost.values()) < 1.6 * np.mean(list(cost.values()))


# 6 languages


def test_viterbi_is_optimal():
    r = np.random.default_rng(0)
    first = np.concatenate(([0], np.cumsum(r.integers(0, 400, 8))))
    scores = r.normal(0, 2, (first[-1], 3)).astype(np.float32)
    labels = langid.viterbi(scores, first, 5.0)
    for a, b in zip(first[:-1], first[1:], strict=True):
        s, x = scores[a:b].astype(float), labels[a:b]
        if len(s):
            best = s[0].copy()
            for row in s[1:]:
                best = np.maximum(best, best.max() - 5) + row
            got = s[np.arange(len(s)), x].sum() - 5 * np.count_nonzero(np.diff(x))
            assert math.isclose(got, best.max(), rel_tol=1e-4)


def test_held_out_languages(spark, docs):
    lang = {r.doc_id: r.lang for r in docs.collect()}
    rows = queries.op6_language_id(spark, SF).collect()
    held = [r for r in rows if r.held_out]
    assert len(rows) == len(lang) and all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 5 == 0) for r in rows)
    assert np.mean([r.lang_pred == lang[r.doc_id] for r in held]) > 0.9 and all(0 <= r.score <= 1 for r in rows)


def test_mixed_text_has_spans(spark, docs):
    first = {}
    for r in docs.orderBy("doc_id").collect():
        if r.lang in ("en", "de") and len(r.text) > 500:
            first.setdefault(r.lang, " ".join(r.text.split()[:50]))
    model = langid.learn(docs)
    mixed = spark.createDataFrame([(1, f"{first['en']} {first['de']}"), (2, None), (3, "12 34 —"), (4, "一")], "doc_id long, text string")
    rows = {r.doc_id: r for r in langid.label(mixed, model).select("record.doc_id", "language.*").collect()}
    assert [s.lang for s in rows[1].spans] == ["en", "de"] and rows[1].spans[0].first == 0 and abs(rows[1].spans[1].first - 50) < 6
    assert [rows[i].lang_pred for i in (2, 3)] == ["und"] * 2 and rows[3].spans == [] and rows[4].lang_pred != "und"


def test_languages_of_odd_rows(odd, none):
    labelled = langid.label(odd, langid.learn(odd)).collect()
    assert all(r.record[c] == i for r in labelled for i, c in enumerate(CLASH))
    rows = [(r.record.doc_id, r.language.lang_pred) for r in labelled]
    assert Counter(rows) == Counter((d, "en" if t and re.search(r"[^\W\d_]", t) else "und") for d, t, _ in ODD)
    assert langid.learn(none) is None and langid.label(none, None).count() == 0
    assert {r.language.lang_pred for r in langid.label(odd, None).collect()} == {"und"}


def test_words_are_letters_and_marks_of_scripts():
    cases = {
        "don’t": ["don", "t"], "giế": ["giế"], "e\u0301te\u0301": ["e\u0301te\u0301"], "a–b…c": ["a", "b", "c"], "« été »": ["été"], "x2y": ["x", "y"], "日本語、漢字": ["日本語", "漢字"], "１２": [],
        "नमस्ते दुनिया": ["नमस्ते", "दुनिया"], "\U0001f600ok\U00020000": ["ok\U00020000"], "": [], "მზე ሰላም": ["მზე", "ሰላም"], "ab": ["ab"], "aé": ["aé"], "éa": ["éa"],
    }
    data = "".join(cases).encode()
    offsets = np.concatenate(([0], np.cumsum([len(t.encode()) for t in cases])))
    starts, ends, first, *_, script = langid.features(np.frombuffer(data, np.uint8), offsets)
    for i, (text, wanted) in enumerate(cases.items()):
        assert [data[a:b].decode() for a, b in zip(starts[first[i] : first[i + 1]], ends[first[i] : first[i + 1]], strict=True)] == wanted, text
    kind = dict(zip([data[a:b].decode() for a, b in zip(starts, ends, strict=True)], script.tolist(), strict=True))
    names = {w: langid.KINDS[k] for w, k in kind.items()}
    assert [names[w] for w in ("giế", "e\u0301te\u0301", "日本語", "नमस्ते", "მზე", "ሰላም", "ok\U00020000")] == ["latin", "latin", "han", "devanagari", "georgian", "ethiopic", "han"]


def test_labels_follow_from_the_spans(spark, docs):
    """lang_pred and score recomputed from the spans and the words between them."""
    model = langid.learn(docs)
    texts = {r.doc_id: r.text for r in docs.collect()}
    for r in langid.label(docs.select("doc_id", "text"), model).collect():
        data = (texts[r.record.doc_id] or "").encode()
        starts, ends, *_ = langid.features(np.frombuffer(data, np.uint8), np.array([0, len(data)]))
        letters, at = Counter(), 0
        for span in r.language.spans:
            assert span.first == at
            letters[span.lang] += int((ends - starts)[span.first : span.last + 1].sum())
            at = span.last + 1
        assert at == (len(starts) if r.language.lang_pred != "und" else 0)
        if letters:
            best = max(sorted(letters), key=letters.get)
            assert r.language.lang_pred == best and math.isclose(r.language.score, letters[best] / sum(letters.values()))


def test_every_language_teaches(spark):
    """Far more languages than a script has words for, each with one text: all are learned and told apart."""
    letters = "abcdefghijklmnopqrstuvwxyz"
    rows = [(i, " ".join(letters[(i * 7 + j * (i % 5 + 1)) % 26] * 3 + letters[i % 26] + letters[i // 26] * 2 for j in range(30)), f"l{i:03}") for i in range(300)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    model = langid.learn(docs)
    assert model.languages == sorted(r[2] for r in rows)
    found = {r.record.doc_id: r.language.lang_pred for r in langid.label(docs, model).collect()}
    assert sum(found[i] == lang for i, _, lang in rows) >= 295


def test_counts_scores_and_labels_by_plain_loops(spark):
    """learn(), scores and labels recomputed letter by letter."""
    import math
    import unicodedata
    from collections import Counter

    texts = [("en", "The cat sat, on the mat 12 times"), ("de", "Der Köter saß auf der Straße"), ("ru", "кот и пёс"), ("el", "η γάτα"), ("en", "cat"), ("de", "")]
    docs = spark.createDataFrame([(i, t, lang) for i, (lang, t) in enumerate(texts)], "doc_id long, text string, lang string")
    model = langid.learn(docs, docs_per_language=1 << 30)
    assert model.languages == ["de", "el", "en", "ru"]

    def words_of(text):
        out = [""]
        for c in text:
            if unicodedata.category(c)[0] in "LM":
                out[-1] += c
            elif out[-1]:
                out.append("")
        return [w for w in out if w]

    def lower(w):
        return bytes(b + 32 if 65 <= b <= 90 else b for b in w.encode())

    def buckets(w):
        padded, tri = b" " + lower(w) + b" ", []
        for i in range(len(padded) - 2):
            x = (padded[i] * 65599 % 2**32) ^ (padded[i + 1] * 2654435761 % 2**32) ^ (padded[i + 2] * (40503 * 97) % 2**32)
            tri.append((x ^ (x >> 15)) % langid.TRIGRAMS)
        data = np.frombuffer(lower(w), np.uint8)
        word = int(langid.tv.segment_hashes(data, np.array([0]), np.array([len(data)]))[0]) % langid.WORDS
        return tri, word

    tris, words, scripts = ({x: Counter() for x in model.languages} for _ in range(3))
    for lang, text in texts:
        for w in words_of(text):
            tri, word = buckets(w)
            tris[lang].update(tri)
            words[lang][word] += 1
            point = max(ord(c) for c in w)
            scripts[lang]["cyrillic" if 0x400 <= point <= 0x52F else "greek" if 0x370 <= point <= 0x3FF else "latin"] += 1

    def log(table, size, lang, bucket):
        one = {x: math.log((table[x][bucket] + langid.SMOOTH) / (sum(table[x].values()) + langid.SMOOTH * size)) for x in model.languages}
        return one[lang] - sum(one.values()) / len(one)

    for text in ("The Köter sat auf the mat", "кот cat γάτα пёс", "zzz qqq"):
        data = np.frombuffer(text.encode(), np.uint8)
        offsets = np.array([0, len(data)])
        starts, ends, first, *rest = langid.features(data, offsets)
        scores = model.scores(starts, ends, *rest)
        path, plain = [], []
        for i, w in enumerate(words_of(text)):
            tri, word = buckets(w)
            point = max(ord(c) for c in w)
            script = "cyrillic" if 0x400 <= point <= 0x52F else "greek" if 0x370 <= point <= 0x3FF else "latin"
            for j, lang in enumerate(model.languages):
                open_ = scripts[lang][script] > langid.SCRIPT_SHARE * max(1, sum(scripts[lang].values()))
                want = sum(log(tris, langid.TRIGRAMS, lang, t) for t in tri) + log(words, langid.WORDS, lang, word)
                if open_:
                    assert abs(scores[i, j] - want) < 1e-3
                else:
                    assert scores[i, j] < -5000
            plain.append(scores[i].astype(float))
        best = {j: (plain[0][j], [j]) for j in range(4)}  # Viterbi over whole paths
        for row in plain[1:]:
            best = {j: max(((v - (15.0 if p[-1] != j else 0.0) + row[j], p + [j]) for v, p in best.values()), key=lambda x: x[0]) for j in range(4)}
        path = max(best.values(), key=lambda x: x[0])[1]
        assert langid.labelled(model, data, offsets, 15.0)[1].tolist() == path


@pytest.mark.parametrize("block,warm", [(4, 0), (4, 2), (7, 7), (256, 32)])
def test_blocks_change_no_label(monkeypatch, block, warm):
    """Blocks agree with one walk over each text whatever they start from, texts of no words too."""
    monkeypatch.setattr(langid, "BLOCK", block)
    monkeypatch.setattr(langid, "WARM", warm)
    rng = np.random.default_rng(block + warm)
    for k in (1, 2, 5, 11):
        counts = rng.integers(0, 60, 12)
        first = np.concatenate(([0], np.cumsum(counts)))
        scores = (rng.normal(size=(first[-1], k)) * 3).astype(np.float32)
        start = rng.normal(size=(12, k)).astype(np.float32) * 9
        got, last, entry = langid.viterbi_between(scores, first, 5.0, start)
        for i in range(12):
            v, back = start[i].astype(float), []
            for row in scores[first[i] : first[i + 1]].astype(float):
                best = int(v.argmax())
                back.append([j if v[j] >= v[best] - 5 else best for j in range(k)])
                v = np.maximum(v, v[best] - 5) + row
            label, path = int(v.argmax()), []
            for step in back[::-1]:
                path.append(label)
                label = step[label]
            assert got[first[i] : first[i + 1]].tolist() == path[::-1] and entry[i] == label
            assert np.abs((last[i] - last[i].max()).clip(-5) - (v - v.max()).clip(-5)).max() < 1e-2


@pytest.mark.parametrize("k", [3, 12])
def test_windows_change_no_label(k):
    rng = np.random.default_rng(k)
    counts = rng.integers(0, 5, (langid.TRIGRAMS + langid.WORDS, k)).astype(float)
    model = langid.Model([f"l{i:02}" for i in range(k)], counts, np.ones((len(langid.KINDS), k)))
    words = ["été", "кот", "word", "日本語", "x", "naïve", "e\u0301a"]
    text = "".join(words[i] + " .,\n。"[j] for i, j in zip(rng.integers(0, 7, 3000), rng.integers(0, 5, 3000))) + "q" * 900 + "語" * 400 + " end"
    data = np.frombuffer(text.encode(), np.uint8)
    starts, ends, first, *rest = langid.features(data, np.array([0, len(data)]))
    whole = langid.viterbi(model.scores(starts, ends, *rest), first, 3.0)
    _, labels, letters = langid._labelled_long(model, data, 3.0, size=400)
    assert labels.tolist() == whole.tolist() and letters.tolist() == (ends - starts).tolist() and len(set(labels.tolist())) > 1
    assert len(list(langid.windows(data, 400))) > 30


def test_only_admitted_languages_are_scored():
    scripts = np.zeros((len(langid.KINDS), 20))
    latin, cyrillic = langid.KINDS.index("latin"), langid.KINDS.index("cyrillic")
    scripts[latin, :12], scripts[cyrillic, 12:] = 5, 5
    model = langid.Model([f"l{i:02}" for i in range(20)], np.ones((langid.TRIGRAMS + langid.WORDS, 20)), scripts)
    assert model.candidates(np.array([cyrillic])).tolist() == list(range(12, 20)) and len(model.candidates(np.array([latin, cyrillic]))) == 20
    seen, plain = [], model.scores
    model.scores = lambda *x: seen.append(len(x[-1])) or plain(*x)
    parts = [x.encode() for x in ("кот и пёс", "a cat", "", "кот cat")]
    data, offsets = np.frombuffer(b"".join(parts), np.uint8), np.cumsum([0, *map(len, parts)])
    langid.labelled(model, data, offsets, 15.0)
    assert sorted(seen) == [8, 12, 20]


@pytest.mark.parametrize("lang", [None, "en"])
def test_labels_by_hand(spark, lang):
    """A score is the letters' share: with one language every word has it."""
    docs = spark.createDataFrame([(1, "ab cd", lang), (2, "12", lang), (3, None, lang)], "doc_id long, text string, lang string")
    rows = {r.record.doc_id: r.language for r in langid.label(docs, langid.learn(docs)).collect()}
    assert [(rows[i].lang_pred, rows[i].score) for i in (2, 3)] == [("und", 0.0)] * 2
    assert (rows[1].lang_pred, rows[1].score, len(rows[1].spans)) == (("en", 1.0, 1) if lang else ("und", 0.0, 0))


# 7 language model


def test_base_scores_and_a_better_model(spark, docs):
    rows = queries.op7_gated_recurrent_lm(spark, "/root/testdata/sf0.01").collect()
    text = {r.doc_id: r.text for r in spark.read.parquet("/root/testdata/sf0.01/documents.parquet").collect()}
    held = {d: zlib.crc32(str(d).encode()) % 10 == 0 for d in text}
    counts = Counter()
    for d, t in text.items():
        if not held[d]:
            counts.update([*WORD.findall(lower(t)), None])
    total, different = sum(counts.values()), len(counts)
    for r in rows:
        tokens = [*WORD.findall(lower(text[r.doc_id])), None]
        base = sum(math.log10((counts[w] + 0.1) / (total + 0.1 * (different + 1))) for w in tokens)
        assert (r.held_out, r.n_tokens, r.n_known, r.train_tokens) == (held[r.doc_id], len(tokens), sum(counts[w] > 0 for w in tokens), total)
        assert math.isclose(r.base_score, base, rel_tol=1e-9)
    better = [(r.score - r.base_score) / r.n_tokens for r in rows if r.held_out]
    assert np.mean(better) > 0.02


def test_gradients(monkeypatch):
    r = np.random.default_rng(0)
    net = gru.Net(r.normal(0, 0.3, gru.Net.SIZE))
    ids, first = r.integers(0, gru.CLASSES * gru.PER_CLASS + gru.TAILS, 60), np.array([0, 20, 45, 60])
    for name, value in {"RATE": 0.0, "LANES": 3, "WINDOW": 100}.items():
        monkeypatch.setattr(gru, name, value)
    moments = [np.zeros(gru.Net.SIZE), np.zeros(gru.Net.SIZE)]
    gru.train(gru.Net(net.flat.copy()), ids, first, moments, 0)
    at = 0
    for shape in gru.Net.SHAPES.values():
        n = int(np.prod(shape))
        i = at + int(np.abs(moments[0][at : at + n]).argmax())
        at += n
        ends = []
        for e in (1e-3, -1e-3):
            flat = net.flat.copy()
            flat[i] += e
            ends.append(gru.log_probabilities(gru.Net(flat), ids, first).astype(float).sum() / 60)
        assert math.isclose(moments[0][i] / 0.1, (ends[0] - ends[1]) / 2e-3, rel_tol=0.02)


def test_probabilities_sum_to_one():
    r = np.random.default_rng(2)
    net = gru.Net(r.normal(0, 0.5, gru.Net.SIZE).astype(np.float32))
    h = r.normal(0, 1, (1, gru.HIDDEN)).astype(np.float32)
    every = np.arange(gru.CLASSES * gru.PER_CLASS + gru.TAILS)
    assert math.isclose(np.exp(net.output(np.repeat(h, len(every), 0), every)[0].astype(float)).sum(), 1, rel_tol=1e-4)


def test_state_goes_on_over_windows_and_lanes():
    r = np.random.default_rng(2)
    net = gru.Net(r.normal(0, 0.5, gru.Net.SIZE).astype(np.float32))
    ids, first = r.integers(0, 1000, 700), np.array([0, 1, 300, 420, 700])
    wanted = gru.log_probabilities(net, ids, first, lanes=1, window=1000)
    assert np.allclose(gru.log_probabilities(net, ids, first, lanes=3, window=7), wanted, atol=1e-3)


def test_scores_equal_plain_loops(spark, monkeypatch):
    """The score of every text by a network written out step by step, in tail classes by the words' counts."""
    r = np.random.default_rng(12)
    net = gru.Net(r.normal(0, 0.4, gru.Net.SIZE).astype(np.float32))
    monkeypatch.setattr(gru, "fit", lambda *_: net)
    some = [f"w{i}" for i in range(1500)]
    rows = [(i, " ".join(some[k] for k in np.minimum(r.zipf(1.3, r.integers(0, 400)), 1500) - 1)) for i in range(40)] + [(90, None), (91, "neverseen W1 w1"), (92, "é日本")]
    rows += [(200 + i, " ".join(some)) for i in range(3)]
    held = {d: zlib.crc32(str(d).encode()) % 10 == 0 for d, _ in rows}
    words = {d: [*WORD.findall(lower(t)), None] for d, t in rows}
    counts = Counter(w for d, x in words.items() if not held[d] for w in x)
    total, different = sum(counts.values()), len(counts)
    frame = spark.createDataFrame(rows, "doc_id long, text string")
    vocab = gru.vocabulary(gru.token_counts(frame.where(~frame.doc_id.isin([d for d in held if held[d]]))))
    p = {name: getattr(net, name).astype(float) for name in gru.Net.SHAPES}
    sig, k, own = lambda x: 1 / (1 + np.exp(-x)), gru.HIDDEN, gru.CLASSES * gru.PER_CLASS

    def log_softmax(x):
        return x - x.max() - np.log(np.exp(x - x.max()).sum())

    def number(w):
        hashes, tails = next((h, t) for _, _, h, t, _ in gru.tokens(pa.array([w or ""])))
        return int(vocab.lookup(hashes[:1], tails[:1])[0][0])

    numbers = {w: number(w) for x in words.values() for w in x}
    for row in gru.score_documents(frame).collect():
        h, before, score = np.zeros(k), gru.Net.START, 0.0
        for w in words[row.doc_id]:
            x, g = p["embed"][before] @ p["wx"] + p["b"], h @ p["wh"]
            gate, keep = sig(x[:k] + g[:k]), sig(x[k : 2 * k] + g[k : 2 * k])
            new = np.tanh(x[2 * k :] + gate * g[2 * k :])
            h, t = new + keep * (h - new), numbers[w]
            classes = log_softmax(h @ p["wc"] + p["bc"])
            if t < own:
                score += (classes[t // gru.PER_CLASS] + log_softmax(p["wo"][t // gru.PER_CLASS] @ h + p["bo"][t // gru.PER_CLASS])[t % gru.PER_CLASS]) / math.log(10)
            else:
                base = math.log10((counts[w] + 0.1) / (total + 0.1 * (different + 1)))
                score += classes[t - own + gru.CLASSES] / math.log(10) + base - vocab.tail_log[t - own]
            before = t
        assert math.isclose(row.score, score, rel_tol=1e-3, abs_tol=1e-2), (row, score)
    assert max(numbers.values()) >= own > min(numbers.values())


def test_rounds_reach_every_document(spark):
    text = " ".join(f"w{i}" for i in range(100))
    words = gru.vocabulary(gru.token_counts(spark.createDataFrame([(text,)], "text string")))
    start = gru.Net.start(words.counts, words.tail_counts).flat
    every = spark.range(64).selectExpr("id AS doc_id", "pmod(xxhash64('round', id), 12) AS part", f"'{text}' AS text").collect()
    assert len({r.part for r in every}) == 12
    for part in range(12):
        of_part = [(r.doc_id, r.text) for r in every if r.part == part] * 4
        net = gru.fit(spark.createDataFrame(of_part, "doc_id long, text string").coalesce(1), words)
        assert not np.array_equal(net.flat, start)


@pytest.mark.parametrize("lengths", [[9000, 8000, 7000, *[40] * 60], [5000], [50], [30, 2, 1]])
def test_every_token_is_learned_from(lengths):
    first = np.concatenate(([0], np.cumsum(lengths)))
    places, starts, runs = gru.laid_out(np.zeros(first[-1], np.int64), first, gru.LANES)
    assert sorted(places[places >= 0].tolist()) == list(range(first[-1]))
    assert sorted(places[starts].tolist()) == first[:-1].tolist() and not (starts & ~runs).any()
    if first[-1] >= 5000:  # the lanes end together
        assert (places >= 0).sum(1).min() > 0.4 * places.shape[1] and len(places) > gru.LANES // 2
    for text in range(min(3, len(lengths))):
        ids = np.zeros(first[-1], np.int64)
        ids[first[text + 1] - 1] = 500  # only a text's last token is a word of this class
        net = gru.Net.start(np.ones(gru.CLASSES * gru.PER_CLASS), np.ones(gru.TAILS))
        wo = net.wo[500 // gru.PER_CLASS].copy()
        gru.train(net, ids, first, [np.zeros(gru.Net.SIZE, np.float32) for _ in range(2)], 0)
        assert not np.array_equal(net.wo[500 // gru.PER_CLASS], wo)


def test_model_on_odd_rows(odd, none):
    rows = gru.score_documents(odd).collect()
    assert Counter((r.doc_id, r.n_tokens) for r in rows) == Counter((d, n_words(t) + 1) for d, t, _ in ODD)
    assert all(r.score < 0 and math.isfinite(r.score) for r in rows)
    assert gru.score_documents(none).count() == 0


# 8 media


def test_media(spark, docs):
    text = {r.doc_id: r.text for r in docs.collect()}
    rows = queries.op8_motion_jpeg(spark, SF).collect()
    assert len(rows) == len(text)
    for r in rows:
        data = text[r.doc_id].encode()
        payload = data + b"\0" * (-len(data) % 64 or (0 if data else 64))
        assert (r.n_bytes, r.payload_bytes, r.payload_sha256, r.tail_crc32) == (len(data), len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-64:]))


def test_media_of_odd_rows_and_all_bytes(odd, none):
    media = mjpeg.to_media(odd)
    rows = mjpeg.features(media).collect()
    assert Counter((r.doc_id, r.n_bytes) for r in rows) == Counter((d, len((t or "").encode())) for d, t, _ in ODD)
    assert {r.media_sha256 for r in media.selectExpr("sha2(media, 256) media_sha256").collect()} == {r.media_sha256 for r in rows}
    assert mjpeg.features(mjpeg.to_media(none)).count() == 0
    data = np.random.default_rng(0).integers(0, 256, 5000).astype(np.uint8).tobytes() + bytes(1024) + b"\xff" * 3000
    frames, length, step = mjpeg.read_avi(mjpeg.to_avi(data))
    assert np.stack(frames).tobytes()[:length] == data and math.isclose(step, 0.04)


def test_a_cut_after_the_first_frame():
    low, high = np.full(mjpeg.FRAME, 10, np.uint8), np.full(mjpeg.FRAME, 200, np.uint8)
    for n in (2, 3, 9):
        assert mjpeg.shots([low, *[high] * (n - 1)], n * mjpeg.FRAME) == [(0, 0), (1, n - 1)]
        assert mjpeg.shots([low] * n, n * mjpeg.FRAME) == [(0, n - 1)]
    assert mjpeg.shots([low], mjpeg.FRAME) == [(0, 0)] and mjpeg.shots([]) == []


def test_shots_and_clips(spark):
    frames = np.repeat(np.array([10, 200, 90], np.uint8), [12, 9, 11])[:, None] * np.ones((1, mjpeg.FRAME), np.uint8)
    assert mjpeg.shots(list(frames), frames.size) == mjpeg.shots([*frames[:12], *frames[12:, :700]]) == [(0, 11), (12, 20), (21, 31)]
    media = spark.createDataFrame([(1, frames.size, bytearray(mjpeg.to_avi(frames.tobytes())))], "doc_id long, n_bytes long, media binary")
    assert [(r.clip, r.first_frame, r.last_frame, round(r.start_s, 2), round(r.end_s, 2)) for r in mjpeg.clips(media).collect()] == [(0, 0, 11, 0.0, 0.48), (1, 12, 20, 0.48, 0.84), (2, 21, 31, 0.84, 1.28)]


def bits_of(value):
    size = abs(value).bit_length()
    return f"{value if value > 0 else value + (1 << size) - 1:0{size}b}" if size else ""


def encoded(image, sampling=(1, 1), restart=0, tables=True, step=4, chroma=None):
    """A baseline JPEG of a grey image, or of one with two flat other components at half size, and what it decodes to."""
    h, v = sampling
    rows, columns = image.shape
    wide, high = -(-columns // (8 * h)), -(-rows // (8 * v))
    padded = np.pad(image, ((0, high * 8 * v - rows), (0, wide * 8 * h - columns)), "edge").astype(float) - 128
    blocks = padded.reshape(high * v, 8, wide * h, 8).transpose(0, 2, 1, 3)
    coded = np.rint(jpeg.WAVES @ blocks @ jpeg.WAVES.T / step).astype(int)
    back = np.clip(np.rint(jpeg.WAVES.T @ (coded * step) @ jpeg.WAVES + 128), 0, 255).astype(np.uint8).transpose(0, 2, 1, 3).reshape(padded.shape)[:rows, :columns]
    zigzag = coded.reshape(high * v, wide * h, 64)[..., jpeg.ZIGZAG]

    def codes(counts, symbols):
        out, code, at = {}, 0, 0
        for length, n in enumerate(counts, 1):
            for symbol in symbols[at : at + n]:
                out[symbol] = f"{code:0{length}b}"
                code += 1
            at, code = at + n, code << 1
        return out

    dc, ac = codes(*jpeg.DC_LUMA), codes(jpeg.AC_LUMA[0], jpeg.completed(jpeg.AC_LUMA[1]))
    parts, text, last = [], "", [0, 0, 0]
    for unit in range(wide * high):
        if restart and unit and unit % restart == 0:
            parts.append(text)
            text, last = "", [0, 0, 0]
        todo = [(0, zigzag[unit // wide * v + y, unit % wide * h + x]) for y in range(v) for x in range(h)]
        todo += [(c, np.array([chroma] + [0] * 63)) for c in (1, 2)] if chroma is not None else []
        for c, block in todo:
            difference, last[c] = int(block[0]) - last[c], int(block[0])
            text += dc[abs(difference).bit_length()] + bits_of(difference)
            run = 0
            for value in block[1 : np.max(np.flatnonzero(block), initial=0) + 1].tolist():
                if not value:
                    run += 1
                    continue
                while run > 15:
                    text, run = text + ac[0xF0], run - 16
                text += ac[run << 4 | abs(value).bit_length()] + bits_of(value)
                run = 0
            text += ac[0] if not np.max(np.flatnonzero(block), initial=0) == 63 else ""
    parts.append(text)
    scan = b""
    for i, part in enumerate(parts):
        part += "1" * (-len(part) % 8)
        scan += int(part or "0", 2).to_bytes(len(part) // 8, "big").replace(b"\xff", b"\xff\0") + (bytes([0xFF, 0xD0 + i % 8]) if i < len(parts) - 1 else b"")
    n = 3 if chroma is not None else 1
    out = b"\xff\xd8" + mjpeg._segment(0xFE, b"a comment") + mjpeg._segment(0xDB, b"\0" + bytes([step] * 64))
    if tables:
        symbols = jpeg.completed(jpeg.AC_LUMA[1])
        out += mjpeg._segment(0xC4, b"\0" + bytes(jpeg.DC_LUMA[0]) + bytes(jpeg.DC_LUMA[1]) + b"\x10" + bytes(jpeg.AC_LUMA[0]) + bytes(symbols))
    out += mjpeg._segment(0xC0, b"\x08" + rows.to_bytes(2, "big") + columns.to_bytes(2, "big") + bytes([n]) + b"".join(bytes([c + 1, h << 4 | v if c == 0 else 0x11, 0]) for c in range(n)))
    out += mjpeg._segment(0xDD, restart.to_bytes(2, "big")) if restart else b""
    return out + mjpeg._segment(0xDA, bytes([n]) + b"".join(bytes([c + 1, 0]) for c in range(n)) + b"\0\x3f\0") + scan + b"\xff\xd9", back


def test_frames_of_other_writers():
    r = np.random.default_rng(3)
    smooth = np.clip(np.add.outer(np.arange(37) * 3, np.arange(50) * 2) + r.normal(0, 25, (37, 50)), 0, 255)
    for how in ({}, {"restart": 3}, {"tables": False}, {"sampling": (2, 2), "chroma": 9}, {"sampling": (2, 1), "chroma": -3, "restart": 2}, {"step": 1}):
        data, wanted = encoded(smooth, **how)
        assert np.array_equal(mjpeg.decode_frame(data), wanted), how
    own = mjpeg.encode_frames(r.integers(0, 256, (1, mjpeg.FRAME)).astype(np.uint8))[0]
    assert np.array_equal(jpeg.luma(own), np.kron(mjpeg.decode_frame(own), np.ones((8, 8), np.uint8)))
    for bad in (b"", data[: len(data) // 2], data.replace(b"\xff\xc0", b"\xff\xc2"), own[:-2], mjpeg.HEADER):
        with pytest.raises(ValueError):
            mjpeg.decode_frame(bad)


def test_clips_of_an_ordinary_file(spark):
    r = np.random.default_rng(4)
    coded = [encoded(np.clip(level + r.normal(0, 3, (24, 40)), 0, 255), sampling=(2, 1), chroma=4)[0] for level in [30] * 5 + [220] * 4]
    movi = b"".join(mjpeg._chunk(b"00dc", x) + mjpeg._chunk(b"01wb", b"sound") for x in coded)
    at, index = 4, []
    for x in coded:
        index.append(b"00dc" + np.array([0x10, at, len(x)], "<u4").tobytes())
        at += 8 + len(x) + len(x) % 2
        index.append(b"01wb" + np.array([0x10, at, 5], "<u4").tobytes())
        at += 14
    head = mjpeg._list(b"hdrl", mjpeg._chunk(b"avih", np.array([40_000, *[0] * 13], "<u4").tobytes()))
    body = b"AVI " + head + mjpeg._list(b"movi", movi) + mjpeg._chunk(b"idx1", b"".join(index))
    data = b"RIFF" + len(body).to_bytes(4, "little") + body
    media = spark.createDataFrame([(1, None, bytearray(data))], "doc_id long, n_bytes long, media binary")
    assert [(c.first_frame, c.last_frame, round(c.start_s, 2), round(c.end_s, 2)) for c in mjpeg.clips(media).collect()] == [(0, 4, 0.0, 0.2), (5, 8, 0.2, 0.36)]
    (row,) = mjpeg.features(media).collect()
    assert (row.payload_sha256, row.media_bytes, row.feature) == (None, len(data), "frames=9;seconds=0.36;shots=2;starts=0,5")


def test_features_tell_of_the_shots(docs):
    """The feature against shots of histograms that are counted one by one."""
    for row, text in zip(mjpeg.features(mjpeg.to_media(docs.orderBy("doc_id"))).collect(), docs.orderBy("doc_id").collect(), strict=True):
        payload = mjpeg.payload_of(text.text)
        chunks = [payload[i : i + mjpeg.FRAME] for i in range(0, len(payload), mjpeg.FRAME)]
        shares = [{g: n / len(c) for g, n in Counter(b >> 4 for b in c).items()} for c in chunks]
        differences = [sum(abs(a.get(g, 0) - b.get(g, 0)) for g in range(16)) / 2 for a, b in zip(shares, shares[1:], strict=False)]
        starts = [0]
        for i, d in enumerate(differences):
            past = differences[max(0, i - mjpeg.WINDOW) : i]
            if d > (max(mjpeg.LEAST, float(np.mean(past) + mjpeg.SPREAD * np.std(past))) if i else mjpeg.LEAST):
                starts.append(i + 1)
        assert row.feature == f"frames={len(chunks)};seconds={len(chunks) * 0.04:.2f};shots={len(starts)};starts={','.join(map(str, starts))}"


# 9 fingerprints


def pieces_of(text):
    data = text.encode()
    own, keys = iblt.pieces(np.frombuffer(data, np.uint8), np.array([0, len(data)]))
    return set(keys.tolist())


@pytest.mark.parametrize("bucket_bytes", [8 << 20, 20_000])
def test_fingerprints(docs, odd, bucket_bytes):
    for frame in (docs, odd):
        rows = iblt.compare_versions(frame, bucket_bytes=bucket_bytes).collect()
        ordered = sorted(((r.doc_id, r.text or "") for r in frame.collect()), key=lambda x: (x[0] is None, -(x[0] or 0)))
        got = defaultdict(list)
        for r in rows:
            got[r.doc_id].append(r)
        for i, (d, text) in enumerate(ordered):
            if d is None or len(got[d]) > 1:
                continue
            after = ordered[(i + 1) % len(ordered)]
            if after[0] is None:
                continue
            k = len(text) // 3
            changed = text[: len(text) - k] + after[1][:k]
            (r,) = got[d]
            assert r.n_chars == len(text) and r.edited_sha256 == hashlib.sha256(changed.encode()).hexdigest()
            for value, other in ((r.near_edited, changed), (r.near_next, after[1])):
                a, b = pieces_of(text), pieces_of(other)
                assert math.isclose(value, len(a & b) / len(a | b) if a | b else 1.0)
        assert len(rows) == len(ordered)
    by_text = defaultdict(set)
    text = {r.doc_id: r.text for r in docs.collect()}
    for r in iblt.compare_versions(docs).collect():
        by_text[text[r.doc_id]].add(r.fingerprint)
    assert all(len(x) == 1 for x in by_text.values())


def test_peeling_recovers_the_difference(none):
    r = np.random.default_rng(5)
    sets = [(set(r.integers(1, 1 << 62, 300).tolist()), n) for n in (0, 1, 40, 250)]
    a, b = ([], []), ([], [])
    for i, (x, n) in enumerate(sets):
        x = sorted(x)
        for side, keys in ((a, x), (b, x[n:] + list(range(1, n + 1)))):
            side[0].extend([i] * len(keys))
            side[1].extend(keys)
    own, keys, sign = iblt.differing(*((np.array(o), np.array(k, np.uint64)) for o, k in (a, b)), len(sets))
    for i, (x, n) in enumerate(sets):
        assert set(keys[(own == i) & (sign == 1)].tolist()) == set(sorted(x)[:n]) and set(keys[(own == i) & (sign == -1)].tolist()) == set(range(1, n + 1))
    assert iblt.compare_versions(none).count() == 0


def test_stored_fingerprints_are_compared():
    r = np.random.default_rng(6)
    base = [sorted(r.integers(1, 1 << 62, n).tolist()) for n in (0, 1, 5, 40, 400)]
    a = [x for x in base for _ in range(3)]
    b = [y for x in base for y in (x, x[: len(x) // 2], [k + 1 for k in x])]
    flat = [(np.repeat(np.arange(len(s)), [len(x) for x in s]), np.array([k for x in s for k in x], np.uint64)) for s in (a, b)]
    prints = [iblt.fingerprints(f, len(a)) for f in flat]
    read = iblt.Sketches.read(prints[0])
    assert read.sizes().tolist() == [len(x) for x in a] and [read.text(i) for i in range(len(a))] == prints[0]
    wanted = [len(set(x) & set(y)) / len(set(x) | set(y)) if x or y else 1.0 for x, y in zip(a, b, strict=True)]
    assert np.allclose(iblt.likeness(*prints, flat), wanted)
    close = [x[:-1] + [5] if x else x for x in a]  # few pieces differ: the fingerprints alone tell them
    near = np.repeat(np.arange(len(a)), [len(x) for x in close]), np.array([k for x in close for k in x], np.uint64)
    nothing = np.zeros(0, np.int64), np.zeros(0, np.uint64)
    told = iblt.likeness(prints[0], iblt.fingerprints(near, len(a)), (nothing, nothing))
    assert np.allclose(told[6:], [(len(x) - 1) / (len(x) + 1) for x in a[6:]])


# 10 licences


def brute_base(text):
    words = re.findall(licenses.WORD, lower(text))
    places = [(i, label) for phrase, label in licenses.BASE for i in range(len(words)) if words[i : i + len(phrase.split())] == phrase.split()]
    return len(words), len(places), min((i for i, _ in places), default=None), max((i for i, _ in places), default=None), ",".join(sorted({x for _, x in places}))


def test_licences(spark, docs, odd, none):
    made = [
        (100, "This is under the MIT license! under the mit license", "s"), (101, "CC-BY-NC and Apache License, Version 2.0", "s"),
        (102, "Licensed under the Apache License, Version 2.0; you may not use it except in full compliance with the license", "s"),
        (103, "Permission is hereby granted, free of charge, to anyone obtaining a copy of this software and its associated documentation files", "s"), (103, "cc by nc cc by nc", "s"),
    ]
    extra = spark.createDataFrame(made, "doc_id long, text string, source string")
    frame = docs.select("doc_id", "text", "source").union(odd.select("doc_id", "text", "source")).union(extra)
    rows = licenses.scan(frame).collect()
    wanted = Counter((r.doc_id, *brute_base(r.text)) for r in frame.collect())
    assert Counter((r.doc_id, r.n_words, r.n_base, r.first_word, r.last_word, r.base_labels) for r in rows) == wanted
    for r in rows:
        assert set(filter(None, r.base_labels.split(","))) <= set(filter(None, r.labels.split(","))) and 0 <= r.score <= 1
    labels = {r.doc_id: r.labels for r in rows if r.doc_id and r.doc_id >= 100}
    assert labels[102] == "apache-2" and "mit" in {r.labels for r in rows if r.doc_id == 103}
    assert licenses.scan(none).count() == 0


def brute_labels(text, templates, k=3, near=3, share=0.6):
    """Every pair of places by two loops, chained diagonals, windows of those that are too wide, and the richest of those that overlap."""
    words = re.findall(licenses.WORD, lower(text))
    spans = []
    for t, (of, label, is_base) in enumerate(templates):
        grams = len(of) - k + 1
        runs = defaultdict(set)
        for i in range(len(words) - k + 1):
            for j in range(grams):
                if words[i : i + k] == of[j : j + k]:
                    runs[i - j].add(j)
        for d, held in runs.items():
            if len(held) == grams:
                spans.append((is_base, d + min(held), d + max(held) + k - 1, label, True, grams, 1.0))
        chains = []
        for d in sorted(runs):
            if chains and d - chains[-1][-1] <= near:
                chains[-1].append(d)
            else:
                chains.append([d])
        for chain in chains:
            ends = [(d + min(runs[d]), d + max(runs[d]), d) for d in chain]
            most = 2 * (grams + k - 1) + near
            seats = [ends]
            if max(e for _, e, _ in ends) - min(s for s, _, _ in ends) + k > most:
                half = most // 2
                cells = {c for s, _, _ in ends for c in (s // half - 1, s // half)}
                seats = [[x for x in ends if x[0] // half in (c, c + 1)] for c in sorted(cells)]
            for seat in seats:
                held = set().union(*(runs[d] for _, _, d in seat))
                if not any(len(runs[d]) == grams for _, _, d in seat) and len(held) / grams >= share:
                    spans.append((is_base, min(s for s, _, _ in seat), max(e for _, e, _ in seat) + k - 1, label, False, len(held), len(held) / grams))
    kept, chain, reach = [], {}, {}
    spans = sorted(set(spans))
    number = 0
    for x in spans:
        if x[0] not in reach or x[1] > reach[x[0]]:
            number += 1
        reach[x[0]] = max(reach.get(x[0], -1), x[2]) if x[0] in reach else x[2]
        chain.setdefault(number, []).append(x)
    for group in chain.values():
        richest = max(x[5] for x in group)
        kept += [x for x in group if x[4] or x[5] == richest]
    return ",".join(sorted({x[3] for x in kept})), max((x[6] for x in kept), default=0.0)


def test_method_labels_equal_brute_force(spark):
    from ferrovia.llm import licence_texts as full

    r = np.random.default_rng(8)
    templates = licenses.template_words()
    rows = []

    def edited(text, every):
        out = []
        for w in text.split():
            x = r.random()
            out += [] if x < every / 2 else [w, "inserted"] if x < every else [w]
        return " ".join(out)

    for text, _ in full.TEXTS:
        rows += ["before " + text + " after", edited(text, 0.04), edited(text, 0.15), edited(text, 0.4), text[: len(text) // 2], " ".join(text.split()[::-1])]
    passage = licenses.PASSAGES[2][0]
    rows += [" ".join([passage] * 9), " ".join(edited(passage, 0.1) for _ in range(40)), "met that the " * 300, f"{full.MIT} {full.ZLIB} {edited(full.ISC, 0.05)}", "", "Cc By Nc " * 20]
    rows += [full.MIT.replace("Software", "\u212aoftware"), "under the MIT licen\u017fe under the MIT \u212aicense UNDER THE MIT LICENSE"]
    frame = spark.createDataFrame(list(enumerate(rows)), "doc_id long, text string")
    for row in licenses.scan(frame).collect():
        labels, score = brute_labels(rows[row.doc_id], templates)
        assert row.labels == labels and math.isclose(row.score, score), (row, labels, rows[row.doc_id][:200])
    of = {r.doc_id: r.labels for r in licenses.scan(frame).collect()}
    for i, (_, label) in enumerate(full.TEXTS):
        assert label in of[6 * i].split(",") and label in of[6 * i + 1].split(",")
    assert "gpl" not in of[6 * 10].split(",") and "agpl" in of[6 * 10].split(",")


def test_many_templates_are_joined_by_shuffle(spark, docs, monkeypatch):
    frame = docs.select("doc_id", "text").union(spark.createDataFrame([(-1, licenses.PASSAGES[0][0]), (-2, None)], "doc_id long, text string"))
    wanted = sorted(map(str, licenses.scan(frame).collect()))
    monkeypatch.setattr(licenses, "MOST_TEMPLATE_WORDS", 0)
    assert sorted(map(str, licenses.scan(frame).collect())) == wanted


# words


def test_words_and_shingles():
    texts = ["Ab  c\td", "e", "", "ef g", "x" * 3]
    data = "".join(texts).encode()
    offsets = np.concatenate(([0], np.cumsum([len(t) for t in texts])))
    starts, ends, first = textvec.words(np.frombuffer(data, np.uint8), offsets)
    assert [data[a:b].decode() for a, b in zip(starts, ends, strict=True)] == ["Ab", "c", "d", "e", "ef", "g", "xxx"]
    assert first.tolist() == [0, 3, 4, 4, 6, 7]


def test_word_hashes_are_no_polynomial():
    words = []
    for bits in range(10, 14):  # Thue-Morse words of 1,024 to 8,192 letters and their complements
        parity = [bin(i).count("1") % 2 for i in range(1 << bits)]
        words += ["".join("ab"[x ^ flip] for x in parity) for flip in (0, 1)]
    words += ["", "a", "aa", "a\0", "\0", "ab" * 4, "ab" * 4 + "a", "b" + "ab" * 4, "x" * 128, "x" * 129, "x" * 5000, "x" * 5001]
    words += ["abcdefgh" + x for x in ("", "a", "b", "aa", "a\0", "abcdefgh", "abcdefgi")]
    data = np.frombuffer("".join(words).encode(), np.uint8)
    ends = np.cumsum([len(w) for w in words])
    hashes = textvec.segment_hashes(data, ends - [len(w) for w in words], ends)
    assert len(set(hashes.tolist())) == len(set(words)) == len(words)
    again = textvec.segment_hashes(np.concatenate([data[:3], data]), ends - [len(w) for w in words] + 3, ends + 3)
    assert np.array_equal(hashes, again)


# pipeline


def test_pipeline(spark):
    import corpus_pipeline

    at = f"{SF}/documents.parquet"
    rows = corpus_pipeline.run(spark, SF).collect()
    ids = {r.doc_id for r in spark.read.parquet(at).collect()}
    assert rows and {r.doc_id for r in rows} <= ids


def test_pipeline_on_odd_rows(spark, odd, none):
    import corpus_pipeline

    for frame in (odd, none):
        docs = frame
        for name, stage in corpus_pipeline.STAGES:
            out = stage(spark, docs, SF)
            if name != corpus_pipeline.STAGES[-1][0]:
                assert out.columns == frame.columns
            docs = corpus_pipeline.written(out, f"test-{name}")
        assert (docs.count() > 0) == (frame is odd)


def test_near_duplicates_under_repeated_ids(spark):
    import corpus_pipeline

    r = np.random.default_rng(4)
    a, b, c, d = (" ".join(f"w{i}" for i in r.integers(0, 9000, 80)) for _ in range(4))
    rows = [
        (1, a), (2, a + " x"), (2, b), (2, b), (3, c), (3, c + " y"), (3, c + " z"), (4, d), (5, d + " t"), (5, None),
        (None, a), (5, "one two"), (6, "one two"), (6, "  "), (7, c + " y"), (None, d),
    ]

    def shingles(t):
        w = WORD.findall(lower(t))
        return {tuple(w[i : i + 5]) for i in range(len(w) - 4)} or ({tuple(w)} if w else set())

    sets = [shingles(t) for _, t in rows]
    group = list(range(len(rows)))
    for i in range(len(rows)):
        for j in range(i):
            if sets[i] and sets[j] and 100 * len(sets[i] & sets[j]) >= 80 * len(sets[i] | sets[j]):
                group = [group[j] if g == group[i] else g for g in group]
    frame = spark.createDataFrame([(i, t, "a", "en", 1, "s") for i, t in rows], "doc_id long, text string, source string, lang string, record int, digest string").repartition(3)
    out = [(x.doc_id, x.text) for x in corpus_pipeline.near_duplicate_stage(spark, frame, SF).collect()]
    loose = [(i, t) for (i, t), s in zip(rows, sets, strict=True) if i is None or not s]
    of_group = defaultdict(list)
    for (i, t), g, s in zip(rows, group, sets, strict=True):
        if i is not None and s:
            of_group[g].append((i, t))
    kept = Counter(out) - Counter(loose)
    assert not Counter(loose) - Counter(out) and sum(kept.values()) == len(of_group) == 5
    for members in of_group.values():
        assert [i for i, t in kept if (i, t) in members] == [min(i for i, _ in members)]


@pytest.mark.parametrize("labelled", [True, False])
def test_pipeline_by_hand(spark, tmp_path, labelled):
    """A small table: what each stage keeps follows from its rule, copies from the seeded draw, pieces from the tokens."""
    import corpus_pipeline

    r = np.random.default_rng(9)
    made = [" ".join(f"word{i}" for i in r.integers(0, 5000, n)) for n in (120, 90, 60, 200, 40, 3000)]
    rows = [
        (1, made[0], "a"), (2, made[0], "b"), (3, made[0] + " more", "a"), (4, made[1], "b"), (5, made[2], None), (6, made[3], "c"), (7, made[4], "c"), (8, made[5], "d"),
        (9, made[5].replace("word7", "x"), "d"), (10, "12 34 !", "a"), (11, None, "a"), (12, "", "b"), (13, "one two", "b"), (14, "ONE  two", "b"), (15, "three", "e"),
    ]
    lang = "en" if labelled else None
    frame = spark.createDataFrame([(*x, lang, "kept", i) for i, x in enumerate(rows)], "doc_id long, text string, source string, lang string, lang_pred string, score int")
    frame.write.parquet(f"file://{tmp_path}/documents.parquet")
    stay = [x for x in rows if x[0] not in (2, 3, 9, 10, 11, 12, 14)]
    docs = frame
    for name, stage in corpus_pipeline.STAGES[:2]:
        docs = corpus_pipeline.written(stage(spark, docs, str(tmp_path)), name)
        assert all(x.lang_pred == "kept" and rows[x.score][0] == x.doc_id and x.lang == lang for x in docs.collect())
    assert sorted((x.doc_id, x.text, x.source) for x in docs.collect()) == sorted(stay)
    sizes = Counter()
    for _, t, source in stay:
        sizes[source] += n_words(t)
    targets = filled(sizes)
    wanted = Counter()
    for d, t, source in stay:
        rate = targets[source] / sizes[source]
        draw = int(hashlib.md5(f"mix:{d}".encode()).hexdigest()[:8], 16) / 2**32
        wanted[d] = int(rate) + (draw < rate - int(rate))
    encode = packing.encoder(public_tokenizers.path("byte_bpe_50k.json"))
    tokens = {d: [*encode(t), 1] for d, t, _ in stay}
    pieces = corpus_pipeline.run(spark, str(tmp_path)).collect()
    got, by_sequence = defaultdict(list), Counter()
    for p in pieces:
        ids = np.frombuffer(bytes(p.ids), "<u4").tolist()
        assert ids == tokens[p.doc_id][p.start : p.start + p.length] and p.doc_tokens == len(tokens[p.doc_id])
        got[p.doc_id] += range(p.start, p.start + p.length)
        by_sequence[p.sequence_id] += p.length
    assert {d: Counter(x) for d, x in got.items()} == {d: Counter({i: n for i in range(len(tokens[d]))}) for d, n in wanted.items() if n}
    assert max(by_sequence.values()) <= 2048 and len(by_sequence) <= sum(by_sequence.values()) // 2048 + 8


def test_a_cluster_needs_a_shared_folder():
    from types import SimpleNamespace as Fake

    from ferrovia.llm import common

    with pytest.raises(RuntimeError, match="spark.checkpoint.dir"):
        common.shared_folder(Fake(conf=Fake(get=lambda *_: None), sparkContext=Fake(master="spark://host:7077")))


# components


@pytest.mark.parametrize("hot", [20_000, 3])
def test_components(spark, monkeypatch, hot):
    monkeypatch.setattr(components, "HOT", hot)
    monkeypatch.setattr(components, "AT_ONCE", 50)
    r = np.random.default_rng(hot)
    links = [(i, i + 1) for i in range(1000, 1300)] + [(5000, i) for i in range(5001, 5200)] + [(i, 6100) for i in range(6000, 6100)] + [tuple(x) for x in r.integers(0, 700, (400, 2)).tolist()]
    links += links[:50] + [(None, 3), (8, 8)]
    r.shuffle(links)
    label = {}
    for a, b in links:
        if a is not None and a != b:
            label.setdefault(a, a)
            label.setdefault(b, b)
    changed = True
    while changed:
        changed = False
        for a, b in links:
            if a is not None and a != b and label[a] != label[b]:
                label[a] = label[b] = min(label[a], label[b])
                changed = True
    frame = spark.createDataFrame([tuple(None if x is None else int(x) for x in link) for link in links], "a long, b long").repartition(7)
    assert {tuple(x) for x in components.components(frame).collect()} == set(label.items())
    assert components.components(frame.where("false")).count() == 0


def test_words_are_looked_up_in_less_than_a_binary_search_of_all():
    import time

    r = np.random.default_rng(4)
    h = np.unique(r.integers(0, 1 << 64, 100_000, dtype=np.uint64))
    h = np.unique(np.concatenate((h, h[:50] + np.uint64(1), np.array([0, 1, 2, (1 << 64) - 1], np.uint64))))
    r.shuffle(h)
    tail = r.integers(0, gru.TAILS, len(h))
    c = np.arange(len(h), 0, -1)
    words = gru.Vocabulary(h, tail, c, int(c.sum()), len(h), np.bincount(tail, c, gru.TAILS), np.bincount(tail, minlength=gru.TAILS).astype(float))
    asked = np.concatenate((h, h + np.uint64(1), r.choice(h, 800_000), r.integers(0, 1 << 64, 1000, dtype=np.uint64)))
    kinds = np.full(len(asked), 5)
    times = {words.lookup: [], np.searchsorted: []}
    for _ in range(5):
        for f, args in ((words.lookup, (asked, kinds)), (np.searchsorted, (words.h, asked))):
            began = time.process_time()
            f(*args)
            times[f].append(time.process_time() - began)
    ids, base, known = words.lookup(asked, kinds)
    at = np.minimum(np.searchsorted(words.h, asked), len(h) - 1)
    there = words.h[at] == asked
    assert np.array_equal(known, there) and np.array_equal(base, np.where(there, words.base[at], 0))
    assert np.array_equal(ids, np.where(there & (words.word[at] >= 0), words.word[at], gru.CLASSES * gru.PER_CLASS + 5))
    assert min(times[words.lookup]) < min(times[np.searchsorted])
