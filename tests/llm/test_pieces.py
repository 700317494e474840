import public_tokenizers
import pytest
import sentencepiece
from hypothesis import given, settings
from hypothesis import strategies as st

from reelframe.llm import pieces as P

PATH = public_tokenizers.path("piece_bpe_32k.model")


def as_unigram(raw: bytes) -> bytes:
    """The model file with its kind set to unigram (field 3 of the trainer settings, field 2 of the file)."""

    def number(at):
        value = shift = 0
        while True:
            b = raw[at]
            value |= (b & 127) << shift
            at, shift = at + 1, shift + 7
            if b < 128:
                return value, at

    def varint(n):
        out = b""
        while n > 127:
            out += bytes([n & 127 | 128])
            n >>= 7
        return out + bytes([n])

    at, out = 0, b""
    while at < len(raw):
        start = at
        tag, at = number(at)
        size, at = number(at)
        body = raw[at : at + size]
        at += size
        if tag == (2 << 3 | 2):
            body += bytes([3 << 3, 1])  # the last value of a field holds
            out += varint(tag) + varint(len(body)) + body
        else:
            out += raw[start:at]
    return out


@pytest.fixture(scope="module")
def library():
    with open(PATH, "rb") as f:
        return sentencepiece.SentencePieceProcessor(model_proto=as_unigram(f.read()))


@pytest.fixture(scope="module")
def tools():
    pieces = P.load(PATH)
    return P.Encoder(pieces), P.Decoder(pieces), pieces


def plain_viterbi(word, pieces, scores):
    worst = min(v for v in scores.values() if v > -1e8) - 10
    best = [(0.0, [])] + [None] * len(word)
    for end in range(1, len(word) + 1):
        for start in range(end):
            piece = word[start:end]
            gain = scores.get(piece, worst if end - start == 1 else None)
            if gain is not None and (best[end] is None or best[start][0] + gain > best[end][0]):
                best[end] = (best[start][0] + gain, best[start][1] + [piece])
    return best[-1][1]


def lattice_best(library, text):
    """The exact search of the library; its default path for one result takes a shortcut."""
    return library.nbest_encode(text, nbest_size=2)[0]


TEXTS = ["Hello world", "the cat sat on the representation of a straightforward thing", "Ärger mit übergröße", "naïve\ncafé\t!", "é∑漢字 x", "aaaaaaaaaaaaaaaaaaaaaaaaaaaaaaa", "x", "print(f'{a:>10}')"]


def test_ids_of_the_library_for_a_unigram_model(library, tools):
    for text in TEXTS:
        assert tools[0].encode([text])[0].tolist() == lattice_best(library, text)


@settings(max_examples=150, deadline=None)
@given(st.lists(st.text(alphabet="abcdethonrsÄß.,", min_size=1, max_size=12), min_size=1, max_size=6))
def test_ids_of_the_library_on_random_words(library, tools, words):
    """Words of known characters; with others the library adds up penalties of 10^9 in single precision."""
    text = " ".join(words)
    assert tools[0].encode([text])[0].tolist() == lattice_best(library, text)


@settings(max_examples=100, deadline=None)
@given(st.text(alphabet="abthenio ▁é\n漢", max_size=18))
def test_a_plain_viterbi_finds_the_same_score(tools, text):
    encoder, _, pieces = tools
    scores = {pieces.texts[i]: float(pieces.scores[i]) for i in range(len(pieces.texts)) if pieces.ordinary[i]}
    places = {pieces.texts[i]: i for i in range(len(pieces.texts)) if pieces.ordinary[i]}
    for word in P._split(text) if text else []:
        encoder.encode([text])
        got = __import__("numpy").frombuffer(encoder.cache[word], "<i4").tolist()
        want = []
        for piece in plain_viterbi(word, pieces, scores):
            want += [places[piece]] if piece in scores else [pieces.byte_ids[b] for b in piece.encode()]
        assert got == want


@settings(max_examples=200, deadline=None)
@given(st.lists(st.one_of(st.none(), st.text(max_size=40)), max_size=5))
def test_round_trip(tools, texts):
    encoder, decoder, _ = tools
    for text, ids in zip(texts, encoder.encode(texts), strict=True):
        assert decoder.decode(ids) == P.plain_text(text)


def test_unknown_characters_leave_the_rest_as_it_is(tools):
    encoder, _, pieces = tools
    scores = {pieces.texts[i]: float(pieces.scores[i]) for i in range(len(pieces.texts)) if pieces.ordinary[i]}
    for word in ("and\nrepresentation", "漢" * 50 + "representation", "\n\nnation", "漢station漢station"):
        encoder.encode([word])
        for w in P._split(word):
            got = [i for i in __import__("numpy").frombuffer(encoder.cache[w], "<i4").tolist()]
            want = []
            for piece in plain_viterbi(w, pieces, scores):
                want += [pieces.texts.index(piece)] if piece in scores else [pieces.byte_ids[b] for b in piece.encode()]
            assert got == want


def test_long_word(tools):
    text = "ab" * 20_000
    ids = tools[0].encode([text])[0]
    assert tools[1].decode(ids) == text


def test_query_columns_and_odd_rows(spark):
    docs = spark.createDataFrame([(1, "Hello world", "z"), (2, None, "z"), (None, "", None), (1, "Hello world", "z")], "doc_id long, text string, ids string")
    rows = P.encode(docs, PATH).orderBy("doc_id").collect()
    assert [r.n_pieces for r in rows][:1] == [0] and all(r.restored for r in rows)
    assert rows[1].ids == rows[2].ids
    back = P.decode(P.encode(docs, PATH), PATH).collect()
    assert sorted(r.text for r in back) == ["", "", "Hello world", "Hello world"]
    assert P.encode(docs.limit(0), PATH).collect() == []
