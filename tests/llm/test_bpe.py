import hashlib
import random

import numpy as np
import pytest
from tokenizers import Tokenizer

from doclattice.llm import bpe, queries
from doclattice.llm.queries import tokenizer_path

HARD = [
    "", "   ", "<|endoftext|> Hello  WORLD's we'll<|startoftext|>x", "a\x1cb!\x1c!   ΣΑΣ İstanbul \x00 ’s",
    "日本語テキスト🙂🙂 é é", "don't I'VE  'S", "a" * 3000, "<|endoftext", "\x85a\xa0b 　c", "a   b", "a  \n b", " \n x", "trail  ",
    "x \n\n  y", "é" * 50 + " zz" * 50, " ".join(["word"] * 5000),
]


def texts():
    rng = random.Random(3)
    out = list(HARD)
    for letters in (" \xa0ab", " \t\n\r\x0b\x0c\x1c\x85\xa0\u1680\u2000\u200a\u200b\u2028\u202f\u205f\u3000ab'", "aeinst ", "ab '\n\t s  t,.12é", "abcdefghijklmnopqrstuvwxyz'’.,!éèßñ 0123\n\tΣ<|>"):
        out += ["".join(rng.choice(letters) for _ in range(rng.randrange(200))) for _ in range(400)]
    return out + ["b \xa0 \xa0 ", "a\n \nb", " \xa0x <|endoftext|> \xa0"]


def read(name):
    with open(tokenizer_path(name), "rb") as f:
        return f.read()


def test_automaton_equals_library():
    own, lib = bpe.WordTokenizer(read("word_bpe_49k.json")), Tokenizer.from_file(tokenizer_path("word_bpe_49k.json"))
    labels = bpe.TokenLabels(read("word_bpe_49k.json"))
    for t in texts():
        ids = lib.encode(t, add_special_tokens=False).ids
        got = own.encode(t)
        assert np.frombuffer(got, "<u4").tolist() == ids, t[:50]
        assert labels.decode(got) == lib.decode(ids, skip_special_tokens=False)


def test_automaton_of_small_merge_lists():
    """Against plain merging, for random merge lists over two letters."""
    rng = random.Random(5)
    for _ in range(150):
        tokens, merges = ["a", "b"], []
        for _ in range(rng.randrange(1, 9)):
            pair = (rng.choice(tokens), rng.choice(tokens))
            if pair not in merges:
                merges.append(pair)
                tokens.append("".join(pair))
        auto = bpe.Automaton(merges)
        for _ in range(30):
            word = [rng.choice("ab") for _ in range(rng.randrange(1, 12))]
            plain = list(word)
            for a, b in merges:
                i = 0
                while i < len(plain) - 1:
                    if (plain[i], plain[i + 1]) == (a, b):
                        plain[i : i + 2] = [a + b]
                    i += 1
            assert auto.encode(word) == plain, (merges, word)


def test_counts_equal_library():
    own, lib = bpe.TokenCounter(read("byte_bpe_50k.json")), Tokenizer.from_file(tokenizer_path("byte_bpe_50k.json"))
    for t in texts():
        assert own.count(t) == len(lib.encode(t, add_special_tokens=False).ids), t[:50]


def test_known_is_bounded(monkeypatch):
    monkeypatch.setattr(bpe.Known, "MOST", 10)
    known = bpe.Known(len)
    assert [known["x" * (i % 40)] for i in range(500)] == [i % 40 for i in range(500)]
    assert len(known) + len(known.older) <= 20


@pytest.mark.parametrize("empty", [False, True])
def test_columns(spark, empty):
    data = bpe.tokenizer_data(spark, tokenizer_path("word_bpe_49k.json"))
    lib = Tokenizer.from_file(tokenizer_path("word_bpe_49k.json"))
    rows = [] if empty else [(1, None, 7), (None, "Hello hello", 7), (2, "", 7), (2, "", 7), (3, "a b " * 4000, 7)]
    docs = queries.prepare(spark) and spark.createDataFrame(rows, "doc_id long, text string, decoded int")
    got = bpe.decode_column(bpe.encode_column(docs, data), data).collect()
    want = {(i, t, lib.decode(lib.encode(t or "", add_special_tokens=False).ids)) for i, t, _ in rows}
    assert {(r.doc_id, r.text, r.decoded) for r in got} == want and len(got) == len(rows)


def test_query_digests(spark, sf_dir):
    lib = Tokenizer.from_file(tokenizer_path("word_bpe_49k.json"))
    text = {r.doc_id: r.text for r in spark.read.parquet(f"{sf_dir}/documents.parquet").collect()}
    got = queries.op9_bpe_automaton(spark, sf_dir).collect()
    assert len(got) == len(text)
    for r in got:
        e = lib.encode(text[r.doc_id], add_special_tokens=False)
        assert r.n_tokens == len(e.ids) and r.ids_sha256 == hashlib.sha256(np.array(e.ids, "<u4").tobytes()).hexdigest()
        assert r.decoded_sha256 == hashlib.sha256(lib.decode(e.ids, skip_special_tokens=False).encode()).hexdigest()


def test_words_longer_than_the_table(monkeypatch):
    own = bpe.WordTokenizer(read("word_bpe_49k.json"))
    rng = random.Random(4)
    word = "".join(rng.choice("abcdefghinorst") for _ in range(5000))
    whole = own.automaton.encode_bytes(word)
    monkeypatch.setattr(bpe.Automaton, "MOST", 40)
    own.automaton.reset()
    assert own.automaton.encode_bytes(word) == whole and len(own.automaton.moves) <= 40


def test_one_step_for_each_symbol(monkeypatch):
    """A word that the table knows asks for no new transition: nothing is tried and taken back."""
    own = bpe.WordTokenizer(read("word_bpe_49k.json")).automaton
    first = own.encode_bytes("straightforwardness")
    monkeypatch.setattr(bpe.Automaton, "step", None)
    assert own.encode_bytes("straightforwardness") == first


@pytest.mark.parametrize("change", [{"unk_token": "?"}, {"vocab": {"a": 0}}])
def test_files_that_are_not_handled(change):
    import json

    spec = json.loads(read("byte_bpe_50k.json"))
    spec["model"] |= change
    with pytest.raises(ValueError):
        bpe.TokenCounter(json.dumps(spec).encode())


def test_count_query_equals_library(spark, sf_dir):
    lib = Tokenizer.from_file(tokenizer_path("byte_bpe_50k.json"))
    text = {r.doc_id: r.text for r in spark.read.parquet(f"{sf_dir}/documents.parquet").collect()}
    got = queries.op10_token_counts(spark, sf_dir).collect()
    assert len(got) == len(text)
    for r in got:
        n = len(lib.encode(text[r.doc_id] or "", add_special_tokens=False).ids)
        assert (r.n_bytes, r.n_tokens, r.over_limit) == (len((text[r.doc_id] or "").encode()), n, n > 1024)


@pytest.mark.parametrize("empty", [False, True])
def test_count_column(spark, empty):
    data = bpe.tokenizer_data(spark, tokenizer_path("byte_bpe_50k.json"))
    lib = Tokenizer.from_file(tokenizer_path("byte_bpe_50k.json"))
    rows = [] if empty else [(1, None, "x"), (None, "Hello hello", "x"), (2, "", "x"), (2, "", "x"), (3, "a b \xa0 " * 40_000, "x")]
    docs = queries.prepare(spark) and spark.createDataFrame(rows, "doc_id long, text string, n_tokens string")
    got = sorted(((r.doc_id, r.n_tokens) for r in bpe.count_column(docs, data).collect()), key=str)
    assert got == sorted(((i, len(lib.encode(t or "", add_special_tokens=False).ids)) for i, t, _ in rows), key=str)


def test_special_strings_of_the_file():
    """Other special strings than those that the files at hand hold."""
    import json

    for name, make, count in (("byte_bpe_50k.json", bpe.TokenCounter, True), ("word_bpe_49k.json", bpe.WordTokenizer, False)):
        spec = json.loads(read(name))
        spec["added_tokens"] = [spec["added_tokens"][0] | {"id": len(spec["model"]["vocab"]) + k, "content": c} for k, c in enumerate(["[SEP]", "[SEP] x", "[§]"])]
        data = json.dumps(spec)
        own, lib = make(data.encode()), Tokenizer.from_str(data)
        for t in ("a [SEP] b", "[SEP] x[§][§] y [SEP]", "[§]", "[SE", "none <|endoftext|> here", " [SEP]  [§]\n"):
            ids = lib.encode(t, add_special_tokens=False).ids
            assert own.count(t) == len(ids) if count else np.frombuffer(own.encode(t), "<u4").tolist() == ids, (name, t)


POINTS = [c for c in range(0x110000) if not 0xD800 <= c < 0xE000]


def test_words_of_every_code_point_equal_the_library_s():
    own, lib = bpe.WordTokenizer(read("word_bpe_49k.json")), Tokenizer.from_file(tokenizer_path("word_bpe_49k.json"))
    bytes_of = lambda w: "".join(own.automaton.labels[b] for b in w.encode())
    for start in range(0, len(POINTS), 400):
        text = " ".join(f"ab{chr(c)}cd 1{chr(c)}2" for c in POINTS[start : start + 400])
        want = [w for w, _ in lib.pre_tokenizer.pre_tokenize_str(lib.normalizer.normalize_str(text))]
        chunks = text.split() if bpe.ODD.search(text) is None else bpe.CHUNK.findall(text)
        assert [bytes_of(w) for c in chunks for w in own.split(c)] == want, start


def test_pre_tokens_of_every_code_point_equal_the_library_s():
    own, lib = bpe.TokenCounter(read("byte_bpe_50k.json")), Tokenizer.from_file(tokenizer_path("byte_bpe_50k.json"))
    bytes_of = lambda w: "".join(own.labels[b] for b in w.encode())
    for c in POINTS:
        text = f"ab{chr(c)}cd"
        assert [bytes_of(w) for w in own.split(text)] == [w for w, _ in lib.pre_tokenizer.pre_tokenize_str(text)], hex(c)
        text = f" 1{chr(c)}2"
        if own.library.odd(text):
            assert [bytes_of(w) for w in own.split(text)] == [w for w, _ in lib.pre_tokenizer.pre_tokenize_str(text)], hex(c)


def test_random_strings_of_odd_characters_equal_the_library_s():
    from doclattice.llm.odd_characters import odd_characters

    rng = random.Random(9)
    odd = odd_characters()
    assert len(odd) > 100
    marks = "\u0301\u0323\u0345\u030aAaEeΣσςİßẞǅﬁ가가'’ \t\u200b12²٣."
    draw = lambda: rng.choice(odd) if rng.random() < 0.3 else rng.choice(marks) if rng.random() < 0.6 else chr(rng.choice(POINTS)) if rng.random() < 0.3 else rng.choice("abc de's 12,.")
    texts = ["".join(draw() for _ in range(rng.randrange(1, 14))) for _ in range(20_000)]
    own, lib = bpe.WordTokenizer(read("word_bpe_49k.json")), Tokenizer.from_file(tokenizer_path("word_bpe_49k.json"))
    counter, bytes_lib = bpe.TokenCounter(read("byte_bpe_50k.json")), Tokenizer.from_file(tokenizer_path("byte_bpe_50k.json"))
    for t, ids, n in zip(texts, lib.encode_batch(texts, add_special_tokens=False), bytes_lib.encode_batch(texts, add_special_tokens=False)):
        assert np.frombuffer(own.encode(t), "<u4").tolist() == ids.ids, ascii(t)
        assert counter.count(t) == len(n.ids), ascii(t)


def test_new_words_of_known_parts_ask_for_few_transitions(monkeypatch):
    """States name places in the trie, not what was read before: words that nobody has seen mostly take transitions that others asked for."""
    own, rng, steps = bpe.WordTokenizer(read("word_bpe_49k.json")).automaton, random.Random(8), []
    step = bpe.Automaton.step
    monkeypatch.setattr(bpe.Automaton, "step", lambda self, at, code: steps.append(1) or step(self, at, code))
    parts = ["th", "er", "tion", "oi", "aux", "elle", "é", "ment", "ich", "sch", "ó", "an"]
    for _ in range(4000):
        own.encode_bytes("".join(rng.choice(parts) for _ in range(rng.randrange(2, 7))))
    assert len(steps) < 1500


def test_arcs_that_are_kept_are_bounded(monkeypatch):
    own = bpe.WordTokenizer(read("word_bpe_49k.json")).automaton
    words = ["straightforwardness", "l'éléphantesque", "unverhältnismäßig", "aaaaaabaaaa"] * 2
    whole = [own.encode_bytes(w) for w in words]
    monkeypatch.setattr(bpe.Automaton, "MOST_ARCS", 3)
    own.states.clear()
    assert [own.encode_bytes(w) for w in words] == whole and len(own.states) <= 8


def test_a_worker_makes_values_of_a_mb_of_text_at_a_time(spark):
    docs = spark.createDataFrame([(i, "x" * 100_000) for i in range(60)], "doc_id long, text string").coalesce(1)
    seen = bpe.map_column(docs, "text", [("held", "long", bpe.pa.int64())], lambda: lambda texts: [[sum(map(len, texts))] * len(texts)])
    assert 100_000 < max(r.held for r in seen.collect()) <= 1 << 20
