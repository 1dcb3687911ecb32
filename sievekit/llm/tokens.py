"""Exact token ids of whole texts with the ``tokenizers`` library, cached by piece.

A text is cut where white space follows a non-space character. No
pre-tokenizer of the supplied vocabularies joins characters across such a
cut, so the ids of a text are the ids of its pieces one after the other. Each
distinct piece of a run of rows is encoded once; the first pieces that a
worker meets (the common ones come first) are kept for its later rows and
tasks. Pieces are encoded many at a time, with a control character that no
merge contains between them. The tests compare this with encoding whole
texts.
"""

from __future__ import annotations

import os
import re
from itertools import chain

import numpy as np

#: The characters with the Unicode property White_Space.
WHITE_SPACE = "\t-\r \x85\xa0  -     　"
_PIECE = re.compile(f"[{WHITE_SPACE}]*[^{WHITE_SPACE}]+|[{WHITE_SPACE}]+")
#: Texts of other characters are cut by the pattern alone: here lower case is one character for one character
#: in every library, nothing is composed, and all white space is the property's.
_NOT_PLAIN = re.compile("[^\t-\r\x20-\x84\x86-\u012f\u0131-\u017e\u2010-\u2027]|<\\|")
#: Pieces that a worker keeps per vocabulary (speed only, never the ids).
CACHE_PIECES = 300_000
#: A longer piece is not kept.
LONG_PIECE = 40
JOINED = 256
MARK = "\x01"


def vocabulary_path(name: str) -> str:
    """Path of a vocabulary file that every worker has (an installed package)."""
    import public_tokenizers

    return public_tokenizers.path(name)


class PieceEncoder:
    """Token ids of texts; one instance per worker and vocabulary (:meth:`of`)."""

    _made: dict[str, PieceEncoder] = {}

    def __init__(self, vocabulary: str) -> None:
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(vocabulary_path(vocabulary))
        self.known: dict[str, bytes] = {}
        self.kept = 0
        one = lambda t: self.tokenizer.encode(t, add_special_tokens=False).ids
        self.mark = one(f" {MARK}")
        self.drops = one("A B") == one(" a\n") + one("b")
        self.joins = one(f"a.b {MARK} c") == one("a.b") + self.mark + one(" c")

    @classmethod
    def of(cls, vocabulary: str) -> PieceEncoder:
        if vocabulary not in cls._made:
            cls._made[vocabulary] = cls(vocabulary)
        return cls._made[vocabulary]

    def _encode(self, pieces: list[str]) -> dict[str, bytes]:
        """uint32 bytes of the ids of each piece."""
        plain, odd = [], []
        for p in pieces:  # a joined piece starts with white space, and neither mark nor special token is in it
            (plain if self.joins and (self.drops or p[0] in " \n") and MARK not in p and "<|" not in p else odd).append(p)
        out = {}
        for p, e in zip(odd, self.tokenizer.encode_batch_fast(odd, add_special_tokens=False), strict=True):
            out[p] = np.array(e.ids, "<u4").tobytes()
        groups = [plain[i:i + JOINED] for i in range(0, len(plain), JOINED)]
        gap = f" {MARK} " if self.drops else f" {MARK}"
        for some in (groups[i:i + 64] for i in range(0, len(groups), 64)):
            coded = self.tokenizer.encode_batch_fast([gap.join(g) + gap for g in some], add_special_tokens=False)
            for g, e in zip(some, coded, strict=True):
                ids = np.array(e.ids, "<u4")
                ends = (np.flatnonzero(ids == self.mark[-1]) + 1) * 4
                data, skip = ids.tobytes(), 4 * len(self.mark)
                if len(ends) != len(g):
                    raise ValueError("a piece holds the mark's token")
                at = 0
                for p, end in zip(g, ends.tolist(), strict=True):
                    out[p] = data[at:end - skip]
                    at = end
        return out

    def _pieces(self, text: str | None) -> list[str]:
        """Pieces of a text; without its white space and capitals where the vocabulary drops them itself."""
        if not text:
            return []
        if self.drops and not _NOT_PLAIN.search(text):
            return text.lower().split()
        return _PIECE.findall(text)

    def ids(self, texts: list[str | None]) -> list[np.ndarray]:
        """uint32 ids of every text, no special tokens added; null is empty."""
        pieces = [self._pieces(t) for t in texts]
        known = self.known
        new = [p for p in set(chain.from_iterable(pieces)) if p not in known]
        known.update(self._encode(new))
        out = [np.frombuffer(b"".join(map(known.__getitem__, row)), "<u4") for row in pieces]
        for p in new:
            if self.kept >= CACHE_PIECES or len(p) > LONG_PIECE:
                del known[p]
            else:
                self.kept += 1
        return out


class ByteEncoder:
    """Ids of ``byte_bpe_50k.json``, worked out by ``tiktoken`` from the same vocabulary.

    Twice as fast as encoding piece by piece and without a cache. Texts with
    characters outside :data:`COMMON_SCRIPTS`, whose classes the two libraries
    might take from different Unicode versions, go to ``tokenizers``; so do
    texts with a white space run over :data:`LONG_RUN`, on which ``tiktoken``
    can run out of stack, and any other text that it refuses.
    """

    _made: ByteEncoder | None = None
    #: Latin, Greek, Cyrillic, punctuation, kana and the common ideographs.
    COMMON_SCRIPTS = re.compile("[^\x00-\u024f\u0370-\u052f\u2010-\u2027\u2030-\u205e\u3001-\u3003\u3041-\u3096"
                                "\u30a1-\u30fa\u4e00-\u9fa5]")
    SPECIAL = {"<|endoftext|>": 50256}
    #: Characters of white space in a row.
    LONG_RUN = 100_000
    _LONG_SPACE = re.compile(f"(?<![{WHITE_SPACE}])[{WHITE_SPACE}]{{{LONG_RUN + 1}}}")

    def __init__(self) -> None:
        import base64

        import public_tokenizers
        import tiktoken

        with open(vocabulary_path("byte_bpe_50k.tiktoken"), "rb") as f:
            ranks = {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, f)}
        self.encoding = tiktoken.Encoding("byte_bpe_50k", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks,
                                          special_tokens=self.SPECIAL)

    @classmethod
    def of(cls) -> ByteEncoder:
        if cls._made is None:
            cls._made = cls()
        return cls._made

    def ids(self, texts: list[str | None]) -> list[np.ndarray]:
        """uint32 ids of every text, no special tokens added; null is empty."""
        out = []
        for t in texts:
            if not t:
                out.append(np.zeros(0, np.uint32))
            elif self.COMMON_SCRIPTS.search(t) or len(t) > self.LONG_RUN and self._LONG_SPACE.search(t):
                out += PieceEncoder.of("byte_bpe_50k.json").ids([t])
            else:
                try:
                    ids = self.encoding.encode_to_numpy(t, allowed_special="all").astype(np.uint32, copy=False)
                except Exception:  # any text that it refuses
                    ids = PieceEncoder.of("byte_bpe_50k.json").ids([t])[0]
                out.append(ids)
        return out


def encoder(vocabulary: str) -> ByteEncoder | PieceEncoder:
    """The worker's encoder for a vocabulary file."""
    return ByteEncoder.of() if vocabulary == "byte_bpe_50k.json" else PieceEncoder.of(vocabulary)


def text_runs(texts: list[str | None], limit: int = 3_000_000) -> list[slice]:
    """Runs of rows of about ``limit`` characters, so that a batch's pieces fit in memory."""
    runs, lo, held = [], 0, 0
    for i, t in enumerate(texts):
        held += len(t or "")
        if held >= limit:
            runs.append(slice(lo, i + 1))
            lo, held = i + 1, 0
    if lo < len(texts):
        runs.append(slice(lo, len(texts)))
    return runs
