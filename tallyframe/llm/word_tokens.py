"""Tokens of a word-level BPE vocabulary: which strings are one token by themselves, and a merge of the rest.

The vocabulary's pre-tokens never hold white space and its normaliser works on each character (or on a character and
its combining marks), so a text's tokens are those of its pieces between ASCII white space, one after another. Pieces
repeat, so each task looks them up in a table of its own and encodes only those that it has not seen.

The proof (``proven_tokens``) rests on one fact about merges by rank. While no merge has crossed the edges of a span, the
span holds a state of the merges of that span alone. So an entry that does not come out of its own bytes alone can
come out of no text, and an entry that does is made by one last pair only. Merging by the rank of the joined bytes,
over the proven entries, is then the same as merging by listed pairs, and much cheaper.
"""

from __future__ import annotations

import functools
import json
import re

from tallyframe.llm import vocab

# Pieces kept per Python worker; a full table starts anew. Longer pieces are encoded each time.
TABLE_ENTRIES = 800_000
TABLE_PIECE_BYTES = 64
# Longer pre-tokens are left to the tokenizer, which merges them in one pass over a queue.
MERGE_BYTES = 256

WORD_END = "</w>"
# Stands for the end of a word in merges; never a byte of UTF-8.
END_BYTE = b"\xff"

# Pieces of these characters are split and lower-cased here: printable ASCII and Latin letters and signs that
# normalisation leaves as they are, each with a lower case of one character. Other pieces go to the tokenizer.
PLAIN = re.compile("[!-~¡-įı-ſ]+")
LETTERS = "a-zªµºß-öø-ſ"
DIGITS = "0-9²³¹¼½¾"
PRE_TOKEN = re.compile(f"'s|'t|'re|'ve|'m|'ll|'d|[{LETTERS}]+|[{DIGITS}]|[^{LETTERS}{DIGITS}]+")


def _byte_alphabet() -> dict[str, int]:
    """The characters that stand for bytes in byte-level vocabularies: printable ones for themselves, others from U+0100."""
    plain = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    out = {chr(byte): byte for byte in plain}
    for number, byte in enumerate(byte for byte in range(256) if byte not in set(plain)):
        out[chr(0x100 + number)] = byte
    return out


@functools.lru_cache(maxsize=2)
def proven_tokens(data: bytes) -> dict[bytes, tuple[int, int]]:
    """Bytes (with ``END_BYTE`` at a word's end) -> (merge rank, id), of the entries that their own bytes encode to."""
    from tokenizers import models

    parts = json.loads(data)["model"]
    if parts["end_of_word_suffix"] != WORD_END or parts["continuing_subword_prefix"] or parts["dropout"]:
        raise ValueError("a vocabulary with word ends and without prefixes or dropout is needed")
    entries, merges = parts["vocab"], [tuple(pair) for pair in parts["merges"]]
    at_end = models.BPE(entries, merges, end_of_word_suffix=WORD_END)
    inside = models.BPE(entries, merges)
    rank = {left + right: number for number, (left, right) in enumerate(merges)}
    letters = _byte_alphabet()
    proven: dict[bytes, tuple[int, int]] = {}
    for token, number in entries.items():
        ends = token.endswith(WORD_END)
        text = token[: -len(WORD_END)] if ends else token
        single = len(text) == 1
        alone = [found.id for found in (at_end if ends else inside).tokenize(text)]
        if alone == [number] and (single or token in rank):
            joined = bytes(letters[letter] for letter in text) + (END_BYTE if ends else b"")
            # Single bytes come first and the mark of the word end joins its byte before any listed merge.
            proven[joined] = (letters[text] + 256 * ends if single else 512 + rank[token], number)
    if len({first for first, _ in proven.values()}) < len(proven) or any(
        bytes([byte]) + END_BYTE not in proven or bytes([byte]) not in proven for byte in range(255)
    ):
        raise ValueError("every byte must be an entry, inside and at the end of a word")
    return proven


class _Known(dict):
    """Values of the pieces that a ``PieceTable`` has met, and of the strings that are one token."""

    def __init__(self, table: "PieceTable"):
        self.table = table
        self.seed = {text.encode(): table.value([number]) for text, number in table.whole.items()}
        super().__init__(self.seed)

    def __missing__(self, piece: bytes):
        value = self.table.value(self.table.encode(piece))
        if len(piece) <= TABLE_PIECE_BYTES:
            if len(self) >= TABLE_ENTRIES:
                self.clear()
                self.update(self.seed)
            self[piece] = value
        return value


class PieceTable:
    """Ids of pieces (UTF-8 bytes between ASCII white space), as a value of any kind made by ``value(ids)``."""

    def __init__(self, data: bytes, value):
        import tiktoken

        self.tokenizer = vocab.word_tokenizer(data)
        self.value = value
        proven = proven_tokens(data)
        # Pre-tokens that are one token: no merge is needed.
        self.whole = {token[:-1].decode(): number for token, (_, number) in proven.items() if _is_word(token)}
        ranks = {token: rank for token, (rank, _) in proven.items()}
        ranks.setdefault(END_BYTE, 255)
        self.ids = {rank: number for rank, number in proven.values()}
        self.merge = tiktoken.Encoding("words", pat_str=".", mergeable_ranks=ranks, special_tokens={})
        special = [token.content for token in self.tokenizer.get_added_tokens_decoder().values()]
        self.special = re.compile("|".join(map(re.escape, special)) or r"(?!)")
        self.known = _Known(self)

    def values(self, text: bytes) -> list:
        """The values of a text's pieces in order."""
        return list(map(self.known.__getitem__, self.split(text)))

    def split(self, text: bytes) -> list[bytes]:
        """Pieces with the same tokens as the text's; A-Z in lower case where that changes none.

        Before a combining mark (U+0300 to U+036F) case decides what is composed, and special tokens are spelt in one case.
        """
        if b"<" in text or b"\xcc" in text or b"\xcd" in text:
            return text.split()
        return text.lower().split()

    def encode(self, piece: bytes) -> list[int]:
        """The ids of a piece: merges of its pre-tokens, or what the tokenizer says where the piece is not plain."""
        ids_of, merge = self.ids, self.merge._core_bpe.encode_single_piece
        if piece.isalpha() and len(piece) <= MERGE_BYTES:
            return [ids_of[rank] for rank in merge(piece.lower() + END_BYTE)]
        text = piece.decode("utf-8", "replace")
        if len(piece) > MERGE_BYTES or not PLAIN.fullmatch(text) or self.special.search(text):
            return self.tokenizer.encode(text, add_special_tokens=False).ids
        ids: list[int] = []
        for part in PRE_TOKEN.findall(text.lower()):
            number = self.whole.get(part)
            if number is None:
                ids += [ids_of[rank] for rank in merge(part.encode() + END_BYTE)]
            else:
                ids.append(number)
        return ids


def _is_word(token: bytes) -> bool:
    """Whether a proven entry at a word's end is, as text, one plain lower-case pre-token."""
    if token[-1:] != END_BYTE:
        return False
    try:
        text = token[:-1].decode()
    except UnicodeDecodeError:
        return False
    return bool(PLAIN.fullmatch(text) and PRE_TOKEN.fullmatch(text) and text == text.lower())


@functools.lru_cache(maxsize=2)
def length_table(data: bytes) -> PieceTable:
    return PieceTable(data, len)
