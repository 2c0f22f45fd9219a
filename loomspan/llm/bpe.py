"""Byte-pair encoding: exact counts from an automaton, exact ids by tree concatenation.

Both rest on one property of byte-pair encoding: a sequence of tokens is *the* encoding
of its bytes if and only if each two neighbouring tokens are the encoding of theirs.
"""

from __future__ import annotations

import base64
import os
from functools import lru_cache

import numpy as np

#: Fixed value: the public pre-token pattern of the byte-level vocabularies.
PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
#: Where the vocabulary files are; a parameter of every operator.
FOLDER = os.environ.get("LOOMSPAN_TOKENIZERS", "/opt/tokenizers")
BYTE_BPE_50K = "byte_bpe_50k.tiktoken"
#: A vocabulary file may be sent to the workers up to this size.
MOST_BYTES = 64 << 20
#: Most code points that are encoded in one piece; longer texts are trees of such leaves.
LEAF = 2048
#: Fixed value: places where the encodings of both sides follow each other, by the pattern above.
SEAM = r"(?<=\S)(?=\s)|(?<=\p{L})(?=[^\p{L}\s])|(?<=\p{N})(?=[^\p{N}\s])"


def read_vocabulary(name: str = BYTE_BPE_50K, folder: str = FOLDER) -> bytes:
    """The file's bytes, read on the driver; refuses a file beyond the broadcast bound."""
    path = os.path.join(folder, name)
    if os.path.getsize(path) > MOST_BYTES:
        raise ValueError(f"{path} is larger than {MOST_BYTES} bytes")
    with open(path, "rb") as file:
        return file.read()


@lru_cache(maxsize=4)
def vocabulary(body: bytes) -> "Vocabulary":
    """One vocabulary per worker process."""
    return Vocabulary({base64.b64decode(a): int(b) for a, b in map(bytes.split, body.splitlines()) if a})


class Vocabulary:
    def __init__(self, ranks: dict[bytes, int]):
        import regex

        self.ranks = ranks
        self.bytes_of = {r: t for t, r in ranks.items()}
        self.pattern = regex.compile(PATTERN)
        self.after, self.before = regex.compile(SEAM), regex.compile(f"(?r){SEAM}")
        self._parts: dict[int, tuple[int, int] | None] = {}
        self._fits: dict[tuple[int, int], bool] = {}
        self._counts: dict[str, int] = {}
        self._automaton = None
        self._encoding = None

    # -- counting -------------------------------------------------------------

    def parts(self, token: int) -> tuple[int, int] | None:
        """The two tokens whose merge made this one; None for a single byte."""
        if token not in self._parts:
            whole = self.bytes_of[token]
            symbols = [whole[i : i + 1] for i in range(len(whole))]
            while len(symbols) > 2:
                ranked = [(self.ranks.get(a + b, token), i) for i, (a, b) in enumerate(zip(symbols, symbols[1:]))]
                rank, i = min(ranked)
                if rank >= token:
                    raise ValueError(f"token {token} can't be built by merges of lower rank")
                symbols[i : i + 2] = [symbols[i] + symbols[i + 1]]
            self._parts[token] = (self.ranks[symbols[0]], self.ranks[symbols[1]]) if len(symbols) == 2 else None
        return self._parts[token]

    def _edge(self, token: int, side: int) -> list[tuple[int, float]]:
        """The tokens that border on one side of a token while it is built, each with the rank that ends it."""
        out: list[tuple[int, float]] = []
        until = float("inf")
        while True:
            out.append((token, until))
            made_of = self.parts(token)
            if made_of is None:
                return out
            until, token = token, made_of[side]

    def fits(self, a: int, b: int) -> bool:
        """Whether the encoding of the bytes of ``a`` and ``b`` is those two tokens.

        It isn't if some merge across the seam comes before a merge that uses up one of
        its two sides. Of equal ranks the left one merges first.
        """
        key = (a, b)
        known = self._fits.get(key)
        if known is None:
            right = [(self.bytes_of[t], until) for t, until in self._edge(b, 0)]
            known = True
            for x, x_until in self._edge(a, 1):
                head = self.bytes_of[x]
                for tail, y_until in right:
                    rank = self.ranks.get(head + tail)
                    if rank is not None and rank < x_until and rank <= y_until:
                        known = False
                        break
                if not known:
                    break
            if len(self._fits) > 2_000_000:
                self._fits.clear()
            self._fits[key] = known
        return known

    @property
    def automaton(self):
        if self._automaton is None:
            import ahocorasick

            self._automaton = ahocorasick.Automaton()
            for token, rank in self.ranks.items():
                self._automaton.add_word(token.decode("latin-1"), (rank, len(token)))
            self._automaton.make_automaton()
        return self._automaton

    def count_piece(self, piece: bytes) -> int:
        """Tokens of one pre-token, in time linear in its length.

        The automaton names the tokens that end at each byte; of them exactly one fits
        the last token of the encoding of what is before it.
        """
        n = len(piece)
        if n < 2:
            return n
        last = [-1] * (n + 1)
        count = [0] * (n + 1)
        fits = self.fits
        for end, (token, size) in self.automaton.iter(piece.decode("latin-1")):
            end += 1
            if last[end] < 0:
                start = end - size
                if start == 0 or (last[start] >= 0 and fits(last[start], token)):
                    last[end] = token
                    count[end] = count[start] + 1
        return count[n]

    def count(self, text: str | None) -> int:
        """Tokens of a text; null and empty texts have none."""
        if not text:
            return 0
        known, total = self._counts, 0
        for match in self.pattern.finditer(text):
            piece = match.group()
            n = known.get(piece)
            if n is None:
                n = self.count_piece(piece.encode("utf-8"))
                if len(piece) <= 64:
                    if len(known) > 500_000:
                        known.clear()
                    known[piece] = n
            total += n
        return total

    # -- encoding -------------------------------------------------------------

    @property
    def encoding(self):
        if self._encoding is None:
            import tiktoken

            self._encoding = tiktoken.Encoding("own", pat_str=PATTERN, mergeable_ranks=self.ranks, special_tokens={})
        return self._encoding

    def piece_ids(self, piece: bytes) -> list[int]:
        """Ids of one pre-token."""
        return self.encoding._core_bpe.encode_single_piece(piece)

    def join(self, left: list[int], right: list[int], start: int = 8) -> list[int]:
        """The encoding of two neighbouring fragments of one pre-token, from theirs.

        A window of tokens around the seam is encoded anew. If its outermost tokens are
        those it replaces, or it has reached a fragment's end, every two neighbours of
        the whole are neighbours in some encoding, so it is exact; otherwise it grows.
        """
        if not left or not right:
            return left + right
        width = start
        while True:
            a, b = min(width, len(left)), min(width, len(right))
            window = self.piece_ids(b"".join(self.bytes_of[t] for t in left[-a:] + right[:b]))
            if (a == len(left) or window[0] == left[-a]) and (b == len(right) or window[-1] == right[b - 1]):
                return left[: len(left) - a] + window + right[b:]
            width *= 2

    def concatenate(self, fragments: list[list[int]]) -> list[int]:
        """Tree concatenation of the encodings of consecutive fragments of one pre-token."""
        while len(fragments) > 1:
            paired = [self.join(a, b) for a, b in zip(fragments[::2], fragments[1::2])]
            fragments = paired + fragments[len(paired) * 2 :]
        return fragments[0] if fragments else []

    def seam(self, text: str) -> int:
        """The place nearest the middle where the encodings of both sides simply follow each other; 0 if there is none.

        A pre-token always begins at white space after something else, and where a run of
        letters or of digits ends; what is before such a place doesn't depend on what follows.
        """
        middle = len(text) // 2
        later = self.after.search(text, middle)
        reach = later.start() - middle if later else len(text)
        earlier = self.before.search(text, max(1, middle - reach), middle)
        return earlier.start() if earlier else later.start() if later else 0

    def leaves(self, text: str, leaf: int) -> list[tuple[bool, str]]:
        """A text in halves at seams until no part is longer than ``leaf``: each part, and whether it joins the one before within a pre-token.

        A part without a seam is cut at its pre-tokens, and a pre-token longer than ``leaf`` in halves.
        """
        done: list[tuple[bool, str]] = []
        waiting = [text]
        while waiting:
            part = waiting.pop()
            at = self.seam(part) if len(part) > leaf else 0
            if at:
                waiting += [part[at:], part[:at]]
            elif len(part) <= leaf:
                done.append((False, part))
            else:
                for match in self.pattern.finditer(part):
                    done += [(i > 0, piece) for i, piece in enumerate(halves(match.group(), leaf))]
        return done

    def leaf_ids(self, joins: bool, whole: bool, text: str) -> list[int]:
        """Ids of one leaf; ``whole`` unless it is a fragment of a pre-token."""
        return self.encoding.encode_ordinary(text) if whole and not joins else self.piece_ids(text.encode("utf-8"))

    def ids(self, text: str | None, leaf: int = LEAF, pool=None) -> np.ndarray | list[int]:
        """Ids of a text, without special tokens; null and empty texts have none.

        By tree concatenation: leaves are encoded on their own, by a pool of threads if one
        is given, and joined pairwise; within a pre-token by windows around the join.
        """
        if not text:
            return []
        if len(text) <= leaf:
            return self.encoding.encode_to_numpy(text, disallowed_special=())
        parts = self.leaves(text, leaf)
        joins = [j for j, _ in parts]
        whole = [not (i + 1 < len(parts) and joins[i + 1]) for i in range(len(parts))]
        # encoders release the interpreter while they work
        encoded = list((pool.map if pool else map)(self.leaf_ids, joins, whole, [t for _, t in parts]))
        out: list[int] = []
        at = 0
        while at < len(parts):
            end = at + 1
            while end < len(parts) and joins[end]:
                end += 1
            out += self.concatenate([list(e) for e in encoded[at:end]])
            at = end
        return out


def halves(text: str, leaf: int) -> list[str]:
    """A long text cut in halves until none is longer than ``leaf``."""
    if len(text) <= max(leaf, 1):
        return [text]
    middle = len(text) // 2
    return halves(text[:middle], leaf) + halves(text[middle:], leaf)
