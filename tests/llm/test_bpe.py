import hashlib
import random

import tokenizers

from tidemark.llm import bpe
from tidemark.llm.queries import byte_bpe_path


def test_ids_and_text_are_the_librarys():
    path = byte_bpe_path()
    library = tokenizers.Tokenizer.from_file(path)
    library.no_truncation()
    library.no_padding()
    own = bpe.Encoder(bpe.load(path))
    for text in ["", " ", "a" * 3000, "  \n\t x　y <|endoftext|> 'll 12é", "The end.\n\nAnd the NEXT one, 1999!", "\U0001f600​\x00 tail  "]:
        ids = library.encode(text, add_special_tokens=False).ids
        assert own.encode(text) == ids
        assert own.decode(ids) == library.decode(ids, skip_special_tokens=False)


def plain(own, piece):
    """Merges by looking for the leftmost lowest pair anew each time."""
    ids = [own.first[b] for b in piece]
    while True:
        ranks = [own.rank.get(a << 20 | b, bpe.NONE) for a, b in zip(ids, ids[1:], strict=False)]
        if not ranks or min(ranks) == bpe.NONE:
            return ids
        at = ranks.index(min(ranks))
        ids[at : at + 2] = [own.into[ranks[at]]]


def test_the_tree_gives_the_ids_of_plain_merging():
    own = bpe.Encoder(bpe.load(byte_bpe_path()))
    rng = random.Random(1)
    for n in [*range(0, 70), 129, 257, 600]:
        for piece in (b"a" * n, (b"internationalisation" * 40)[:n], (b"ab cd" * 140)[: max(0, n - 2)] + b"he", bytes(rng.choice(b"etaoin shrdlu") for _ in range(n))):
            assert own.merge(piece) == plain(own, piece)


def test_the_query_s_rows(spark):
    path = byte_bpe_path()
    library = tokenizers.Tokenizer.from_file(path)
    rows = [(1, "The end.", "x", 1), (1, "The end.", "x", 1), (2, None, None, 2), (None, "", "y", 3), (4, "z" * 5000 + " tail", "", 4)]
    frame = spark.createDataFrame(rows, "doc_id long, text string, n_tokens string, id int")
    got = sorted(map(tuple, bpe.digest_documents(frame, path).collect()), key=str)
    want = []
    for i, text, *_ in rows:
        ids = library.encode(text or "", add_special_tokens=False).ids
        want.append((i, len(ids), hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest(), hashlib.sha256(library.decode(ids, skip_special_tokens=False).encode()).hexdigest()))
    assert got == sorted(want, key=str)
    assert bpe.digest_documents(frame.limit(0), path).count() == 0


def test_short_pieces_take_no_linked_leaves(monkeypatch):
    """A piece of one node is merged in it: no tree is built, whatever the piece."""
    own = bpe.Encoder(bpe.load(byte_bpe_path()))
    monkeypatch.setattr(own, "merge_tree", None, raising=True)
    rng = random.Random(4)
    for n in range(bpe.FAN + 2):
        for _ in range(200):
            piece = bytes(rng.choice(b"etaoin shrdlu\xc3\xa9") for _ in range(n))
            assert own.merge(piece) == plain(own, piece)


def test_a_piece_is_spelt_once_and_runs_of_spaces_keep_their_place():
    path = byte_bpe_path()
    library = tokenizers.Tokenizer.from_file(path)
    library.no_truncation()
    library.no_padding()
    own = bpe.Encoder(bpe.load(path))
    assert own.chunk(" again") is own.piece(" again")
    rng = random.Random(6)
    for _ in range(400):
        text = "".join(rng.choice(["a", "The", "é", " ", "  ", "\n", "\t", "　", "1", "!", "'s", "<|endoftext|>"]) for _ in range(rng.randrange(40)))
        ids = library.encode(text, add_special_tokens=False).ids
        assert own.encode(text) == ids
        assert own.digest(text)[0] == len(ids)
