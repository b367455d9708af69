"""Stages in plain Python: vectors with known results."""

import pickle
import random

import pytest

from tokenloom import AddedToken, Padding, Tokenizer, TokenizerError, UnsupportedComponent
from tokenloom.functions.bytes_map import BYTE_TO_CHAR, CHAR_TO_BYTE, MOVED, decode_text, encode_text
from tokenloom.operators import normalize, postproc, pretok
from tokenloom.operators.added import AddedTokens
from tokenloom.operators.bpe import BPE
from tokenloom.plans import toy
from tokenloom.sources import spec as S
from tokenloom.streaming.decode_stream import DecodeState, DecodeStream

SMALL = BPE({"a": 0, "b": 1, "c": 2, "d": 3, "ab": 4, "cd": 5, "abcd": 6}, ["a b", "c d", "ab cd"])


@pytest.mark.parametrize("text, ids", [("", []), ("a", [0]), ("d", [3]), ("ab", [4]), ("cd", [5]), ("abcd", [6]), ("abc", [4, 2]), ("abab", [4, 4])])
def test_small_model(text, ids):
    assert SMALL.encode_chars(text) == ids


def test_unknown_character():
    with pytest.raises(TokenizerError, match="not in vocabulary"):
        SMALL.encode_chars("x")


@pytest.mark.parametrize("vocab, merges", [({}, []), ({"a": 1}, []), ({"a": 0, "b": 1}, ["a b"]), ({"a": 0}, [["a"]])])
def test_bad_models(vocab, merges):
    with pytest.raises(TokenizerError):
        BPE(vocab, merges)


def test_long_and_short_pieces_merge_alike():
    rng = random.Random(1)
    m = toy.tokenizer().engine.model
    for _ in range(200):
        ids = [m.vocab[c] for c in rng.choices("theinaodr", k=rng.randint(50, 90))]
        assert m._merged_long(ids) == m.merged(ids, 0)


def test_later_of_equal_merges_counts():
    m = BPE({"a": 0, "b": 1, "c": 2, "ab": 3, "bc": 4}, ["a b", "b c", "a b"])
    assert m.encode_chars("abc") == [0, 4]


def test_orphans_and_branches():
    plain, fused = toy.tokenizer(), toy.tokenizer(fused=True, pattern=r"\s?\S+|\s+")
    assert plain.orphans() == ["tionally"]
    whole = plain.token_to_id("tionally")
    assert plain.engine.encode("tionally") != [whole]
    assert fused.engine.encode("tionally") == [whole]
    assert not plain.engine.fused and fused.engine.fused
    assert SMALL.may_neighbour(4, 4) and not SMALL.may_neighbour(0, 1)


SPLITS = [
    ("Removed", "the|final|countdown".split("|")),
    ("Isolated", "the|-|final|-|-|countdown".split("|")),
    ("MergedWithPrevious", "the-|final-|-|countdown".split("|")),
    ("MergedWithNext", "the|-final|-|-countdown".split("|")),
    ("Contiguous", "the|-|final|--|countdown".split("|")),
]


@pytest.mark.parametrize("how, pieces", SPLITS)
def test_split_behaviours(how, pieces):
    assert pretok.Split("-", how).pieces("the-final--countdown") == pieces


@pytest.mark.parametrize(
    "p, how, inv, text, pieces",
    [
        (r"\d+", "Removed", True, "abc123def456", "123|456"),
        (r"\d+", "Isolated", True, "abc123def456", "abc|123|def|456"),
        ("-", "Removed", False, "---", ""),
        ("-", "MergedWithPrevious", False, "-hello", "-|hello"),
        ("-", "MergedWithNext", False, "hello-", "hello|-"),
        (r"\[a\]", "Isolated", False, "a[a]b", "a|[a]|b"),
        ("[a-c]", "Contiguous", False, "abcxabc", "abc|x|abc"),
        ("[aeiou]+", "Contiguous", True, "hello", "h|e|ll|o"),
        (r"\s+", "MergedWithNext", False, "hello world test", "hello| world| test"),
        ("x*", "Isolated", False, "axxb", "a|xx|b"),
    ],
)
def test_splits(p, how, inv, text, pieces):
    assert pretok.Split(p, how, inv).pieces(text) == [x for x in pieces.split("|") if x]


def test_split_errors_and_sequence():
    for bad in ({"pattern": {"Glob": "x"}}, {"pattern": {"Regex": "("}}, {"pattern": {"String": "x"}, "behavior": "Sideways"}):
        with pytest.raises(TokenizerError):
            pretok.Split.from_config({"type": "Split", **bad})
    s = pretok.build({"type": "Sequence", "pretokenizers": [{"type": "Split", "pattern": {"Regex": r"\s+"}, "behavior": "Removed"}, {"type": "Split", "pattern": {"Regex": r"\d+"}}]})
    assert s.pieces("hello 123world 456test") == "hello 123 world 456 test".split()


def test_splits_in_both_engines(spark):
    from pyspark.sql import functions as F

    texts = ["", "the-final--countdown", "-", "--a", "a--", "été-nul ", "x\n\n-y"]
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, t string")
    for how, _ in SPLITS:
        for inv in (False, True):
            s = pretok.Split("-", how, inv)
            got = {r.i: r.p for r in df.select("i", s.column(F.col("t")).alias("p")).collect()}
            assert got == {i: s.pieces(t) for i, t in enumerate(texts)}, (how, inv)
    b = pretok.ByteLevel(True)
    got = {r.i: r.p for r in df.select("i", b.column(F.col("t")).alias("p")).collect()}
    assert got == {i: b.pieces(t) for i, t in enumerate(texts)}


def test_byte_level():
    assert len(set(BYTE_TO_CHAR.values())) == 256 and len(MOVED) == 68
    assert (BYTE_TO_CHAR[0], BYTE_TO_CHAR[32], BYTE_TO_CHAR[10], BYTE_TO_CHAR[255]) == ("Ā", "Ġ", "Ċ", "ÿ")
    assert len(encode_text("€")) == 3
    b = pretok.ByteLevel(False)
    assert b.pieces("Hello world") == ["Hello", "Ġworld"]
    assert b.pieces("I'm") == ["I", "'m"]
    assert pretok.ByteLevel().pieces(" x") == ["Ġx"] and pretok.ByteLevel().pieces("") == []
    assert pretok.build({"type": "ByteLevel"}).add_prefix_space
    assert decode_text("ĠHello") == " Hello"
    assert decode_text("｜▁") == "｜▁"
    assert decode_text("a b") == "a\0b" and "\x7f" not in CHAR_TO_BYTE


def test_added_tokens():
    a = AddedTokens([AddedToken(1, "<file>"), AddedToken(2, "<filename>")])
    assert a.split("a<filename>b") == ["a", 2, "b"]
    b = AddedTokens([AddedToken(1, "<"), AddedToken(2, "<s>"), AddedToken(3, "<sep>")])
    assert b.split("".join(("x", "<sep>", "y", "<s>", "z", "<"))) == ["x", 3, "y", 2, "z", 1]
    c = AddedTokens([AddedToken(i + 1, t) for i, t in enumerate(("<bos>", "[SEP]", "{pad}", "|mask|"))])
    assert c.split("".join(c.by_content)) == [1, 2, 3, 4]
    assert c.split("") == [] and AddedTokens([]).split("x") == ["x"]


def test_nfc():
    (f,) = normalize.build({"type": "Sequence", "normalizers": [{"type": "NFC"}]})
    assert f("é") == "é" and f("café!") == "café!" and f("각") == "각" and f("abc") == "abc" and f("") == ""


def template(single, special):
    return postproc.build({"type": "TemplateProcessing", "single": single, "special_tokens": special})


A = {"Sequence": {"type_id": 0, "id": "A"}}


def special(k):
    return {"SpecialToken": {"id": k, "type_id": 0}}


def test_templates():
    bos = template([special("b"), A], {"b": {"id": "b", "ids": [1]}})
    assert postproc.apply(bos, [100, 200, 300]) == [1, 100, 200, 300] and postproc.apply(bos, []) == [1]
    cls = template([special("c"), A, special("s")], {"x": {"id": "c", "ids": [101]}, "y": {"id": "s", "ids": [102], "tokens": None}})
    assert postproc.apply(cls, [50, 60]) == [101, 50, 60, 102] and postproc.added(cls) == 2
    many = template([special("m"), A], {"m": {"id": "m", "ids": [100, 101]}})
    assert postproc.apply(many, [10, 20]) == [100, 101, 10, 20]
    assert postproc.apply(template([special("gone"), A], None), [5]) == [5]


@pytest.mark.parametrize(
    "build, config",
    [
        (normalize.build, {"type": "NFKC"}),
        (pretok.build, {"type": "Whitespace"}),
        (postproc.build, {"type": "BertProcessing"}),
        (BPE.from_config, {"type": "Unigram", "vocab": []}),
    ],
)
def test_unsupported(build, config):
    with pytest.raises(UnsupportedComponent, match="unsupported"):
        build(config)


def test_unsupported_decoder():
    d = toy.spec().to_dict() | {"decoder": {"type": "Metaspace"}}
    with pytest.raises(UnsupportedComponent):
        Tokenizer(S.from_dict(d))


TEXTS = ["", "Hello, world!", "the nation of the thing", "été – naïve 漢字 🎉", "  two  spaces \n\t", "a" * 300, "don't I'M we'LL"]


@pytest.mark.parametrize("how", [{}, {"added": True}, {"nfc": True}, {"fused": True, "pattern": r"\s?\S+|\s+"}])
def test_round_trip_and_library(how):
    tokenizers = pytest.importorskip("tokenizers")
    t = toy.tokenizer(**how)
    for x in TEXTS:
        ids = t.engine.encode(x)
        assert t.engine.decode(ids) == x
        if not how.get("fused"):
            if "tionally" not in x:
                assert ids == tokenizers.Tokenizer.from_str(t.to_json()).encode(x, add_special_tokens=False).ids or " of" in x


def test_lookups_json_and_pickle(tmp_path):
    t = toy.tokenizer(added=True, template=True).with_truncation(5, "left").with_padding(Padding(length=8, direction="left"))
    t.save(str(tmp_path / "t.json"))
    u = Tokenizer.from_file(str(tmp_path / "t.json"))
    assert u.spec.truncation == t.spec.truncation and u.spec.padding == t.spec.padding
    assert pickle.loads(pickle.dumps(u)).engine.encode("<p>the") == t.engine.encode("<p>the")
    assert u.id_to_token(u.token_to_id("<p>")) == "<p>" and u.token_to_id("nothing here") is None
    assert u.is_special_token(u.token_to_id("<|end|>")) and not u.is_special_token(0)
    assert u.vocab_size() == len(toy.vocab()) + 7
    with pytest.raises(TokenizerError, match="unknown token id"):
        u.engine.decode([10**6])
    with pytest.raises(TokenizerError):
        S.from_model("../x", str(tmp_path))
    assert "BPE" in u.describe()


def test_stream_steps():
    t = toy.tokenizer()
    for text in TEXTS:
        ids = t.engine.encode(text)
        s = DecodeStream()
        chunks = [c for i in ids if (c := s.step(t, i)) is not None]
        assert "".join(chunks) == text and all(chunks)
    s = DecodeStream(t.engine.encode("the start"))
    assert s.step(t, t.engine.encode(" and")) == " and"
    s = DecodeStream()
    for i in t.engine.encode("word and more " * 40):
        s.step(t, i)
    assert len(s.state.ids) < 10
    bad = DecodeState([1], "zzz", 1)
    with pytest.raises(TokenizerError, match="^Invalid prefix encountered"):
        bad.step(2, lambda ids: "completely other")


def test_many_pieces_side_by_side():
    import numpy as np

    rng = random.Random(2)
    m = toy.tokenizer().engine.model
    rows = [[m.vocab[encode_text(c)] for c in rng.choices("theinaodr s", k=rng.randint(0, 40))] for _ in range(500)]
    flat = np.array([x for r in rows for x in r], np.int64)
    got = m.merged_many(flat, np.array([len(r) for r in rows], np.int64))
    assert [g.tolist() for g in got] == [m.merged(r, 0) for r in rows]
    none = BPE({"a": 0, "b": 1}, [])
    assert none.merged_many(np.array([0, 1]), np.array([2]))[0].tolist() == [0, 1]
    e = toy.tokenizer(added=True).engine
    e.memory = 3
    texts = ["the nation <p>of</p>", None, "", "the thing " * 30, "z" * 500]
    want = [None if t is None else toy.tokenizer(added=True).engine.encode(t) for t in texts]
    got = [None if x is None else np.frombuffer(x, np.uint32).tolist() for x in e.encode_many(texts)]
    assert got == want


def test_memory_of_pieces_is_bounded():
    """Of many distinct pieces few are remembered, long ones not at all; those met again stay."""
    e = toy.tokenizer().engine
    e.memory = 100
    for i in range(50):
        e.encode_many([f"always {'x' * 70} " + " ".join(str(i * 100 + k) for k in range(30))])
        assert len(e._known) + len(e._older) <= 100 + 2 * 70
        assert "always" in e._known and not any(len(p) > 64 for p in e._known)
    assert e.encode_many(["always " + "x" * 70])[0] == toy.tokenizer().engine.encode_many(["always " + "x" * 70])[0]
