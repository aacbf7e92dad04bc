"""Byte-level BPE of whole Arrow columns with a public vocabulary file.

The library encodes every distinct piece of text once; a piece is what stands between single
blanks.  Where a blank has no white space on either side, the split pattern of byte-level BPE
always parts the text before the blank, so the ids of a text are those of its pieces.  Texts
with other white space around a blank are given to the library whole.
"""

import os
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

from appcensus.llm.words import blocks, text_bytes

MEMO_PIECES = 800_000
"""Above this the memo keeps the pieces that came again; some 150 bytes a piece."""
BLOCK_BYTES = 4 << 20
JOINED = 1_000
"""Pieces given to the library at once."""

# Python counts some separators as white space that the pattern does not, and the other way
# round; pieces that begin or end with one of either kind are not split off.
_ODD_SPACE = "᠎​﻿"


def default_vocabulary() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


def _stands_alone(piece: str) -> bool:
    return bool(piece) and not (
        piece[0].isspace() or piece[-1].isspace() or piece[0] in _ODD_SPACE or piece[-1] in _ODD_SPACE
    )


def load(path: str):
    """The tokenizer of a vocabulary file, without truncation and padding, in one thread."""
    os.environ["TOKENIZERS_PARALLELISM"] = "false"
    from tokenizers import Tokenizer

    tokenizer = Tokenizer.from_file(path)
    tokenizer.no_truncation()
    tokenizer.no_padding()
    return tokenizer


class Encoder:
    """Encodes texts; its memo of pieces is bounded and lives as long as the worker."""

    _of_path: dict[str, "Encoder"] = {}

    @classmethod
    def of(cls, path: str) -> "Encoder":
        if path not in cls._of_path:
            cls._of_path[path] = cls(path)
        return cls._of_path[path]

    def __init__(self, path: str):
        self.tokenizer = load(path)
        vocabulary = self.tokenizer.get_vocab(with_added_tokens=True)
        added = self.tokenizer.get_added_tokens_decoder()
        self.token_bytes = np.zeros(max(vocabulary.values()) + 1, np.int64)
        for token, number in vocabulary.items():
            # One character of a token is one byte, but for added tokens, which are plain text.
            text = token.encode() if number in added else token
            self.token_bytes[number] = len(text)
        self.text_of_id = [str(i) for i in range(len(self.token_bytes))]
        self.blank: dict[str, int] = {}  # pieces after a blank, by what follows the blank
        self.head: dict[str, int] = {}  # pieces that begin a text
        self.starts = np.zeros(1, np.int64)
        self.ids = np.zeros(0, np.uint32)
        self.seen = np.zeros(0, np.int64)

    def _shrink(self) -> None:
        """Forget pieces that came once."""
        lasting = np.flatnonzero(self.seen > 1)
        number = np.full(len(self.seen), -2, np.int64)
        number[lasting] = np.arange(len(lasting))
        for name in ("blank", "head"):
            old = getattr(self, name)
            setattr(self, name, {p: int(number[s]) for p, s in old.items() if s >= 0 and number[s] >= 0})
        lengths = np.diff(self.starts)[lasting]
        at = np.repeat(self.starts[lasting] - (np.cumsum(lengths) - lengths), lengths)
        self.ids = self.ids[at + np.arange(len(at))]
        self.starts = np.append(0, np.cumsum(lengths))
        self.seen = np.zeros(len(lasting), np.int64)

    def whole(self, text: str) -> np.ndarray:
        return np.array(self.tokenizer.encode(text, add_special_tokens=False).ids, np.uint32)

    def _add(self, memo: dict[str, int], pieces: list[str], ids: np.ndarray, lengths) -> None:
        first = len(self.starts) - 1
        memo.update(zip(pieces, range(first, first + len(pieces))))
        self.ids = np.concatenate([self.ids, ids])
        self.starts = np.append(self.starts, self.starts[-1] + np.cumsum(lengths))
        self.seen = np.append(self.seen, np.zeros(len(pieces), np.int64))

    def _learn_blank(self, pieces: list[str]) -> None:
        """Pieces after a blank: the library gets many in one text, and token sizes part them."""
        groups = [pieces[k : k + JOINED] for k in range(0, len(pieces), JOINED)]
        found = self.tokenizer.encode_batch_fast(
            [" " + " ".join(g) for g in groups], add_special_tokens=False
        )
        flat = np.concatenate([np.array(f.ids, np.uint32) for f in found])
        ends = np.cumsum([len(p.encode()) + 1 for p in pieces])
        upto = np.cumsum(self.token_bytes[flat])
        at = np.searchsorted(upto, ends) + 1
        if not np.array_equal(upto[at - 1], ends):
            raise ValueError("a piece does not end with a token")
        self._add(self.blank, pieces, flat, np.diff(at, prepend=0))

    def _learn_head(self, pieces: list[str]) -> None:
        ids = [self.whole(p) for p in pieces]
        self._add(self.head, pieces, np.concatenate(ids), [len(x) for x in ids])

    def _slots(self, memo: dict[str, int], learn, pieces: list[str]) -> np.ndarray:
        """Slot of each of the different ``pieces``; -1 for one that cannot stand alone."""
        get = memo.get
        slots = np.array([get(p, -2) for p in pieces], np.int64)
        new = np.flatnonzero(slots == -2)
        if len(new):
            fit = [k for k in new.tolist() if _stands_alone(pieces[k])]
            slots[new] = -1
            if fit:
                learn([pieces[k] for k in fit])
                slots[fit] = np.arange(len(self.starts) - 1 - len(fit), len(self.starts) - 1)
        return slots

    def _block(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        if len(self.seen) > MEMO_PIECES:
            self._shrink()
        split = pc.split_pattern(texts, " ")
        first = split.offsets.to_numpy()[:-1] - split.offsets[0].as_py()
        pieces = split.flatten()
        coded = pieces.dictionary_encode()
        slot = self._slots(self.blank, self._learn_blank, coded.dictionary.to_pylist())
        slot = slot[coded.indices.to_numpy()]
        heads = pieces.take(pa.array(first)).dictionary_encode()
        of_head = self._slots(self.head, self._learn_head, heads.dictionary.to_pylist())
        slot[first] = of_head[heads.indices.to_numpy()]
        alone = slot < 0
        slot[alone] = 0
        self.seen += np.bincount(slot, minlength=len(self.seen))[: len(self.seen)]
        if len(self.starts) > 1:
            starts = self.starts[slot]
            lengths = self.starts[slot + 1] - starts
        else:
            starts = lengths = np.zeros(len(slot), np.int64)
        rows = np.repeat(np.arange(len(first)), np.diff(np.append(first, len(slot))))
        odd = np.zeros(len(first), bool)
        odd[rows[alone]] = True
        lengths[odd[rows]] = 0
        counts = np.bincount(rows, lengths, len(first)).astype(np.int64)
        total = int(lengths.sum())
        at = np.repeat(starts - (np.cumsum(lengths) - lengths), lengths) + np.arange(total)
        flat = self.ids[at]
        if odd.any():
            parts, ends = [], np.cumsum(counts)
            for row in range(len(first)):
                if odd[row]:
                    parts.append(self.whole(texts[row].as_py()))
                    counts[row] = len(parts[-1])
                else:
                    parts.append(flat[ends[row] - counts[row] : ends[row]])
            flat = np.concatenate(parts)
        return flat, counts

    def encoded(self, texts: pa.Array) -> Iterator[np.ndarray]:
        """The ids of each text, a block of texts at a time; null counts as empty."""
        texts = pc.fill_null(texts.cast(pa.large_string()), "")
        _, offsets = text_bytes(texts)
        for row, stop in blocks(offsets, BLOCK_BYTES):
            flat, counts = self._block(texts.slice(row, stop - row))
            yield from np.split(flat, np.cumsum(counts)[:-1])

    def encode(self, texts: pa.Array) -> list[np.ndarray]:
        return list(self.encoded(texts))
