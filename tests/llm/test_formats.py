"""Mixing, chat windows, SentencePiece, token files, WARC: round trips and brute force."""

import hashlib
import re
import zlib

import numpy as np
import public_tokenizers
import pytest
from pyspark.sql import functions as F

from unitweave.llm import chat_format, mixing, sentencepiece_codec, token_binary, warc_index


def test_water_filling(spark):
    sizes = spark.createDataFrame([("a", 1), ("b", 1000), ("c", 10), (None, 500), ("z", 0)], "source string, source_size long")
    out = {r["source"]: r["target"] for r in mixing.source_targets(sizes).collect()}
    total, weight, size = 1511, {"a": 1, "b": 2, "c": 3, "z": 1, None: 2}, {"a": 1, "b": 1000, "c": 10, "z": 0, None: 500}
    want, clamped = {}, {}
    while True:
        free = [s for s in weight if s not in clamped]
        share = (total - sum(clamped.values())) / sum(weight[s] for s in free)
        over = [s for s in free if share * weight[s] > 3 * size[s]]
        if not over:
            want = clamped | {s: share * weight[s] for s in free}
            break
        clamped |= {s: 3 * size[s] for s in over}
    assert out == pytest.approx(want)


def test_mix(hard_docs, hard_rows, no_docs):
    out = mixing.mix(hard_docs).collect()
    assert len(out) == len(hard_rows) and all(0 <= r["taken"] <= 3 * r["size"] for r in out)
    assert sorted(map(repr, out)) == sorted(map(repr, mixing.mix(hard_docs.repartition(7)).collect()))
    for source in {r["source"] for r in out}:
        own = [r for r in out if r["source"] == source]
        assert abs(sum(r["taken"] for r in own) - own[0]["target"]) <= max(r["size"] for r in own)
    assert mixing.mix(no_docs).count() == 0
    again = mixing.repeat_rows(hard_docs)
    assert again.columns == hard_docs.columns
    words = lambda t: len(re.findall(r"[^\x20\x09-\x0D]+", t or ""))
    counted = {}
    for r in again.collect():
        counted[r["doc_id"], r["source"]] = counted.get((r["doc_id"], r["source"]), 0) + words(r["text"])
    taken = {}
    for r in out:
        taken[r["doc_id"], r["source"]] = taken.get((r["doc_id"], r["source"]), 0) + r["taken"]
    assert {k: v for k, v in counted.items() if v} == {k: v for k, v in taken.items() if v}
    assert mixing.repeat_rows(no_docs).count() == 0


@pytest.mark.parametrize("span, history", [(20, 8), (1, 1), (512, 128)])
def test_chat_round_trip(spark, span, history):
    said = ["a b c", "</s>[INST] ok [/INST]", "[~TURN] x", "[TURN]~[~~SAYS]", None, "", "w " * 50, "<<SYS>> é 😀"]
    alone = [(None, 0, "user", "no conversation"), (None, 1, "assistant", "said")]
    rows = alone + [(c, t, "system" if t == 0 and c % 2 else ("user", "assistant", None, "[TURN]r")[t % 4], said[(c + t) % 8]) for c in range(5) for t in range(9)] + [(1, 3, "assistant", "twice"), (2, None, "assistant", "no turn")]
    turns = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    windows = chat_format.format_windows(turns.withColumn("place", F.lit(1)), span, history)
    read = {r["conv_id"]: r for r in chat_format.read_windows(windows).collect()}
    for c in (None, *range(5)):
        own = sorted(((t is None, t or 0, r is not None, r or "", x is not None, x or "") for i, t, r, x in rows if i == c))
        want = [(r, x) for _, _, _, r, _, x in own]
        assert sorted(map(tuple, read[c]["turns"])) == sorted(want) and len(read[c]["turns"]) == len(want)
        assert sorted(read[c]["loss_texts"]) == sorted(x for r, x in want if r == "assistant")
    bound = 53 + span + history + 60
    assert all(r["n_tokens"] <= bound for r in windows.collect())
    assert chat_format.read_windows(chat_format.format_windows(turns.limit(0))).count() == 0
    with pytest.raises(ValueError):
        chat_format.format_windows(turns, 5, 6)


def test_escape_is_reversible(spark):
    parts = ["[", "<", "~", "TURN]", "SAYS]", "/s>", "s>", "<SYS>>", "INST]", "x"]
    texts = ["".join(parts[(i * k + k * k) % len(parts)] for k in range(12)) for i in range(200)]
    rows = spark.createDataFrame([(t,) for t in texts], "t string").select("t", chat_format.escape(F.col("t")).alias("e")).withColumn("u", chat_format.unescape(F.col("e"))).collect()
    assert all(r["t"] == r["u"] and not any(x in r["e"] for x in ("[TURN]", "[SAYS]", "</s>")) for r in rows)


def test_pieces_round_trip(spark, hard_docs, hard_rows, sf_docs, no_docs):
    """The library reads the ids back as the texts, and needs about as many of its own for them."""
    import sentencepiece

    path = public_tokenizers.path("piece_bpe_32k.model")
    model = sentencepiece.SentencePieceProcessor(model_file=path)
    for docs in (hard_docs, sf_docs):
        rows = sentencepiece_codec.encode(docs, path).collect()
        texts = {}
        for r in docs.select("doc_id", "text").collect():
            texts.setdefault(r["doc_id"], []).append((r["text"] or "").replace("▁", " "))
        assert sorted((repr(r["doc_id"]), model.decode(r["ids"])) for r in rows) == sorted((repr(i), t) for i, some in texts.items() for t in some)
        assert all(r["n_pieces"] == len(r["ids"]) and r["round_trip"] == (r["doc_id"] != 10 or docs is sf_docs) for r in rows)
        own, wanted = sum(r["n_pieces"] for r in rows), sum(len(model.encode(t)) for some in texts.values() for t in some)
        assert abs(own - wanted) < 0.03 * wanted
    encoded = sentencepiece_codec.encode(hard_docs, path)
    back = sorted((repr(r["doc_id"]), r["text"]) for r in sentencepiece_codec.decode(encoded, path).collect())
    assert back == sorted((repr(i), (t or "").replace("▁", " ")) for i, t, _ in hard_rows)
    assert sentencepiece_codec.encode(no_docs, path).count() == 0


def test_odd_texts_come_back(spark):
    import sentencepiece

    path = public_tokenizers.path("piece_bpe_32k.model")
    model = sentencepiece.SentencePieceProcessor(model_file=path)
    texts = ["  a  b\n\tc ﬁ <s>x</s> ｆ", " ", "    ", "<0x41> <unk>", "=====-----", "a" * 200, "\x01\x02", "门 ข😀é̀", "x\r\ny\u00a0z\u3000", "  lead", "trail  ", "\n  \n"]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    rows = {r["doc_id"]: r for r in sentencepiece_codec.encode(docs, path).collect()}
    assert all(rows[i]["round_trip"] and model.decode(rows[i]["ids"]) == t for i, t in enumerate(texts))
    broken = spark.createDataFrame([(1, [model.piece_to_id("<0xC3>"), model.piece_to_id("▁a")]), (2, None), (3, [None, 1, model.piece_to_id("▁a")]), (4, [])], "doc_id long, ids array<int>")
    assert {r["doc_id"]: r["text"] for r in sentencepiece_codec.decode(broken, path).collect()} == {1: "\ufffd a", 2: "", 3: "a", 4: ""}


def test_no_piece_spans_two_units(spark):
    """So a text's best path is that of its units; pieces that only the length of a unit cuts are runs."""
    model = sentencepiece_codec.load(public_tokenizers.path("piece_bpe_32k.model"))
    names = spark.createDataFrame([(f"x {p[0].replace('▁', ' ')}" if p[0][0] != "▁" else p[0].replace("▁", " "),) for p in model.pieces], "text string")
    cut = names.select("text", sentencepiece_codec.units(F.col("text")).alias("u")).collect()
    spanning = [r["text"] for r in cut if len(r["text"].strip()) and len([x for x in r["u"] if x.strip("▁")]) > (2 if r["text"].startswith("x ") else 1)]
    assert spanning == []


def test_parts_are_whole_units(spark):
    """Cut by the pattern of units, the parts of a text give the units of the text, also where words, marks and spaces run on."""
    texts = [
        "", " ", "a", " a", "a  b", "a   b ", "B,, c. D,.\n\nE.", "x" * 70 + " y", "a\x01b, c", "▁a b", "tab\tx \n y\n", "don't. stop, e\u0301, 5, 6.", "a,\r\n b",
        "." * 80 + ", z", "a." * 30 + " b", "https://x.y/z?q=1,2, ok", "y " + "z" * 33 + ", w", "\n", "ünï, cödé. 😀, ½.",
    ]
    docs = spark.createDataFrame([(t,) for t in texts], "text string")
    rows = docs.select("text", sentencepiece_codec.units(F.col("text")).alias("units"), sentencepiece_codec.parts(F.col("text")).alias("parts"))
    again = F.flatten(F.transform("parts", lambda p: F.regexp_extract_all(p, F.lit(sentencepiece_codec._UNITS), F.lit(0))))
    for r in rows.select("*", again.alias("again")).collect():
        assert r["units"] in (r["parts"], r["again"]) and all(len(p) <= sentencepiece_codec.UNIT + 1 for p in r["parts"]), r["text"]


def test_texts_are_not_shuffled(spark, sf_docs):
    """They are the bulk of the table: blocks are made where texts are read, and only parts and their ids are exchanged."""
    out = sentencepiece_codec.encode(sf_docs, public_tokenizers.path("piece_bpe_32k.model"))
    plan = out._jdf.queryExecution().explainString(spark._jvm.org.apache.spark.sql.execution.ExplainMode.fromString("formatted"))
    exchanged = re.findall(r"\(\d+\) (?:Broadcast)?Exchange\nInput \[\d+\]: \[(.*)\]", plan)
    assert exchanged and not any(re.search(r"\b(text|rows)#", columns) for columns in exchanged)


def test_common_and_rare_parts(spark, sf_docs, monkeypatch):
    """Parts that all blocks get and those sent to single blocks give the same ids as without the one or the other."""
    path, got, spreads = public_tokenizers.path("piece_bpe_32k.model"), [], []
    of = sentencepiece_codec._spread
    monkeypatch.setattr(sentencepiece_codec, "_spread", lambda told: spreads.append(of(told)) or spreads[-1])
    for most in (0, 3000, 10**9):
        monkeypatch.setattr(sentencepiece_codec, "COMMON", most)
        got.append(sorted((r["doc_id"], r["ids"]) for r in sentencepiece_codec.encode(sf_docs, path, 1 << 16).collect()))
    assert got[0] == got[1] == got[2] and spreads[0] > spreads[1] > spreads[2] == 1


def test_viterbi(spark):
    pieces = {"a": 10, "b": 15, "ab": 20, "abc": 22, "c": 30, "bc": 14, "ca": 90}
    words = ["abc", "abcab", "ca", "", "axb", "x", None, "abc", "aaaa"]

    def best(word):
        paths = [(0, [])] + [None] * len(word)
        for end in range(1, len(word) + 1):
            for size in range(1, min(3, end) + 1):
                piece = word[end - size : end]
                cost = pieces.get(piece, sentencepiece_codec.UNKNOWN_COST if size == 1 else None)
                if cost is not None and (paths[end] is None or paths[end - size][0] + cost < paths[end][0]):
                    paths[end] = (paths[end - size][0] + cost, paths[end - size][1] + [(end, piece if piece in pieces else None)])
        return paths[-1][1]

    number = {p: i for i, p in enumerate(pieces)}
    table = spark.createDataFrame([(p, number[p], c) for p, c in pieces.items()], "piece string, id long, cost long")
    out = sentencepiece_codec.viterbi(spark.createDataFrame([(w,) for w in words], "unit string"), table, 3).collect()
    assert sorted(r["unit"] for r in out) == sorted({w for w in words if w is not None})
    for r in out:
        assert [tuple(x) for x in r["path"]] == [(end, number.get(piece)) for end, piece in best(r["unit"])]
    with pytest.raises(ValueError):
        sentencepiece_codec.viterbi(table, table, 64)


def test_token_files(spark, hard_docs, hard_rows, no_docs, monkeypatch):
    from tokenizers import Tokenizer

    path = public_tokenizers.path("byte_bpe_50k.json")
    library = Tokenizer.from_file(path)
    monkeypatch.setattr(token_binary, "FILE_IDS", 100)
    got = sorted(((r["start"], r["doc_id"], r["n_tokens"], r["ids_crc32"]) for r in token_binary.write_and_read(hard_docs, path).collect()))
    want, at = {}, 0
    ids = {(i, t): np.array(library.encode(t or "", add_special_tokens=False).ids + [2], "<u4") for i, t, _ in hard_rows}
    assert sorted((repr(d), n, c) for _, d, n, c in got) == sorted((repr(i), len(ids[i, t]), zlib.crc32(ids[i, t].tobytes())) for i, t, _ in hard_rows)
    for start, doc, n, _ in got:
        assert start == at
        at += n
    numbered = [d for _, d, _, _ in got]
    assert numbered[0] is None and numbered[1:] == sorted(numbered[1:])
    assert token_binary.write_and_read(no_docs, path).count() == 0


def test_token_folder_is_read_by_path(spark, tmp_path):
    """What another session would have: the folder alone."""
    docs = spark.createDataFrame([(3, "three words here"), (1, None), (2, "two")], "doc_id long, text string")
    path, folder = public_tokenizers.path("byte_bpe_50k.json"), f"file://{tmp_path}/ids"
    encoded = token_binary.encode_ids(docs, path)
    token_binary.write_files(encoded, folder, token_binary.id_ranks(encoded))
    out = sorted(map(tuple, token_binary.read_files(spark, folder).collect()))
    assert [(d, n) for d, _, n, _ in out] == [(1, 1), (2, 2), (3, 4)] and [s for _, s, _, _ in out] == [0, 1, 3]


def test_matches_equal_the_library():
    encoder = token_binary.MatchEncoder(public_tokenizers.path("byte_bpe_50k.json"))
    texts = ["", "  a  b\n\n c\t\td  ", "a\x1c b  c", " 　x", "it's we'll  don't\n 'tis", "<|endoftext|> hi", "é  ß\r\n\r\n  z\n", "\n", "x#!y 12ab Straße'", "a\u00a0b \u0085 c", "“so” it’s – 日本 😀"]
    rng = np.random.default_rng(6)
    every = [chr(c) for c in [*range(0x250), *range(0x2010, 0x2030)]]
    often = list(" \n\t'aeéstlvrmdZ19²,.#")
    for _ in range(3000):
        texts.append("".join(every[rng.integers(len(every))] if rng.random() < 0.2 else often[rng.integers(len(often))] for _ in range(rng.integers(1, 25))))
    texts += ["".join(every), " ".join(every), " 1".join(every)]
    assert encoder.encode(texts) == encoder.whole(texts)
    assert sum(token_binary._OTHER.search(t) is None for t in texts) > 1000


def test_added_tokens_equal_the_unmodified_library():
    from tokenizers import Tokenizer

    path = public_tokenizers.path("byte_bpe_50k.json")
    library, encoder = Tokenizer.from_file(path), token_binary.MatchEncoder(path)
    texts = ["end <|endoftext|> of", "<|endoftext|>", "a<|endoftext|><|endoftext|>\n b", "<|endoftext |> <|endoftex", "plain text", "", "  x\u00a0<|endoftext|>y"]
    assert [np.frombuffer(x, encoder.dtype).tolist() for x in encoder.encode(texts)] == [library.encode(t, add_special_tokens=False).ids for t in texts]


def test_texts_above_a_slice(spark):
    """Texts longer than a slice, and wide Arrow offsets, through the operators that read batches."""
    from unitweave.llm import quality_rules, substring_dedup, toxicity

    long = " ".join(f"w{i}" for i in range(300_000))
    docs = spark.createDataFrame([(1, long), (2, "short"), (3, long + " end"), (4, None)], "doc_id long, text string").coalesce(1)
    path = public_tokenizers.path("byte_bpe_50k.json")
    told = []
    for wide in ("false", "true"):
        spark.conf.set("spark.sql.execution.arrow.useLargeVarTypes", wide)
        try:
            cut = {r["doc_id"]: r["n_removed"] for r in substring_dedup.remove_repeats(docs).collect()}
            counted = {r["doc_id"]: r["n_words"] for r in quality_rules.apply_rules(docs, quality_rules.Model()).collect()}
            scored = toxicity.score(docs, toxicity.Model(np.zeros(0, np.uint64), np.zeros(0))).count()
            ids = sorted(map(tuple, token_binary.write_and_read(docs, path).collect()))
        finally:
            spark.conf.unset("spark.sql.execution.arrow.useLargeVarTypes")
        told.append((cut, counted, scored, ids))
    assert told[0] == told[1]
    assert told[0][0] == {1: 0, 2: 0, 3: 300_000, 4: 0} and told[0][1] == {1: 300_000, 2: 1, 3: 300_001, 4: 0} and told[0][2] == 4


def test_packing():
    rng = np.random.default_rng(1)
    for n in (0, 1, 3, 4, 1000):
        ranks = (rng.integers(0, 1 << 32, n) >> rng.integers(0, 32, n)).astype(np.uint32)
        assert (token_binary.unpack(*token_binary.pack(ranks), n) == ranks).all()


def test_warc(spark):
    big, other = "p" * 1200, "é" * 600
    rows = [(1, "http://www.a.example.com/x y?q=1", big), (2, "http://www.a.example.com/x y?q=1", big), (3, None, big), (4, "nonsense\r\nurl", other), (5, "http://[bad", other), (6, "http://a.com", "s"), (7, "http://a.com", "s"), (8, "http://b.com#f", None), (None, "http://c.com", big)]
    pages = spark.createDataFrame([(*r, "x") for r in rows], "page_id long, url string, html string, key string").repartition(3)
    out = {r["page_id"]: r for r in warc_index.archive_and_read(pages).collect()}
    assert len(out) == len(rows)
    for i, _, html in rows:
        payload = (html or "").encode()
        assert out[i]["payload_bytes"] == len(payload) and out[i]["payload_digest"] == hashlib.sha1(payload).hexdigest()
    assert {i: (r["record_type"], r["refers_to"]) for i, r in out.items() if r["record_type"] == "revisit"} == {1: ("revisit", 3), 2: ("revisit", 3), None: ("revisit", 3), 4: ("revisit", 5)}
    assert warc_index.archive_and_read(pages.limit(0)).count() == 0
    assert warc_index.url_key("HTTP://Www.Ex.com:80/a?b") == "com,ex,www)/a?b"


def test_index_look_ups(spark, tmp_path):
    pages = spark.createDataFrame([(i, f"http://h{i % 7}.com/p{i % 13}", f"text {i}") for i in range(300)], "page_id long, url string, html string")
    folder = f"file://{tmp_path}"
    captures = warc_index.write_archives(pages, folder)
    warc_index.write_index(captures, folder, block_lines=9)
    index = warc_index.CaptureIndex(folder, keep=2)
    for i in (0, 7, 150, 299):
        headers, payload = index.record(warc_index.url_key(f"http://h{i % 7}.com/p{i % 13}"), i)
        assert payload == f"text {i}".encode() and headers["WARC-Type"] == "response"
    assert not list(index.find("com,h1)/none", 1)) and not list(index.find("", None)) and not list(index.find("zz", 5))
    with pytest.raises(KeyError):
        index.record("com,h1)/none", 1)


def test_rows_that_repeat_url_and_page(spark, tmp_path):
    """Each row is a record of its own, also where many share key and page_id over several blocks; revisits find their payload."""
    rows = [(1, "http://a.com/x", f"text {i}" * (i + 1)) for i in range(40)] + [(2, "http://a.com/x", "p" * 2000)] * 3 + [(1, "http://a.com/x", "p" * 2000), (None, None, None), (None, None, "z" * 1500), (2, "http://a.com/x", "q" * 1500), (1, "http://b.com", "q" * 1500)]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string").repartition(3)
    out = sorted((repr(r["page_id"]), r["payload_bytes"], r["payload_digest"], r["record_type"], r["refers_to"] or 0) for r in warc_index.archive_and_read(pages).collect())
    again = lambda i, h: h is not None and i == 1 and h[0] in "pq"
    assert out == sorted((repr(i), len(h or ""), hashlib.sha1((h or "").encode()).hexdigest(), "revisit" if again(i, h) else "response", 2 if again(i, h) else 0) for i, _, h in rows)
    folder = f"file://{tmp_path}"
    captures = warc_index.write_archives(pages, folder)
    warc_index.write_index(captures, folder, block_lines=4)
    index = warc_index.CaptureIndex(folder, keep=2)
    assert len(list(index.find("com,a)/x", 1))) == 41 and len({index.read(p)[0]["WARC-Record-ID"] for p in index.find("com,a)/x", 2)}) == 4
