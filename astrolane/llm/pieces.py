"""A SentencePiece BPE model as a lattice of pieces.

Two facts make prefix counts and parallel encoding exact.  A piece never holds
the space mark after another character, so words, each with its leading mark, are
encoded alone.  And in the encoding of a string every pair of neighbours is
*compatible*: encoding the two pieces' joined text gives the two pieces back;
conversely a chain of compatible neighbours is the encoding.  So every prefix of
a word has exactly one last piece that is compatible with the last piece of what
precedes it, and a dynamic program over prefixes finds it without encoding again.
Runs of space marks are no exception: their merges have equal scores, of which the
leftmost comes first, and compatibility minds that.
"""

from __future__ import annotations

import re
from collections.abc import Callable

import sentencepiece

MARK = "▁"
#: Stands for a character that has no piece and becomes bytes.
UNKNOWN = ""
#: Characters of a word, its mark among them, whose chain is kept for other words.
HEAD = 6


class PieceModel:
    """Pieces and scores of a BPE model with byte fallback, and its lattice."""

    def __init__(self, path: str, cache: int = 400_000):
        self.lib = sentencepiece.SentencePieceProcessor(model_file=path)
        n = self.lib.get_piece_size()
        plain = [i for i in range(n) if not (self.lib.is_byte(i) or self.lib.is_control(i) or self.lib.is_unknown(i) or self.lib.is_unused(i))]
        self.ids = {self.lib.id_to_piece(i): i for i in plain}
        self.score = {p: self.lib.get_score(i) for p, i in self.ids.items()}
        self.byte_ids = [self.lib.piece_to_id(f"<0x{b:02X}>") for b in range(256)]
        self.longest = max(map(len, self.ids))
        if any(MARK in p.lstrip(MARK) for p in self.ids):
            raise ValueError("a piece of this model spans words")
        #: when a piece is made, and of what; characters are there from the start
        self.rank = {p: -s for p, s in self.score.items()}
        self.made: dict[str, float] = {}
        self.halves: dict[str, tuple[str, str]] = {}
        #: pieces that encoding can give: those that their own text is encoded to
        self.reached = set()
        for p in self.ids:
            if len(p) == 1:
                self.reached.add(p)
            elif len(parts := self.merge(p, 2)) == 2 and "".join(parts) in self.ids and self.merge(p) == [p]:
                self.made[p], self.halves[p] = self.rank[p], (parts[0], parts[1])
                self.reached.add(p)
        #: the pieces read backwards: from an end, character by character; under the empty string a piece that is whole there
        self.endings: dict = {}
        for p in self.reached:
            at = self.endings
            for c in reversed(p):
                at = at.setdefault(c, {})
            at[""] = p
        self.pairs: dict[tuple[str, str], bool] = {}
        self.heads: dict[str, tuple[list[str | None], list[int]]] = {}
        self.cache = cache

    def merge(self, text: str, until: int = 1) -> list[str]:
        """Plain BPE: join the best-scored neighbours, leftmost of equals, until none can be joined or so few are left."""
        parts, score = list(text), self.score
        while len(parts) > until:
            best, at = None, -1
            for i in range(len(parts) - 1):
                s = score.get(parts[i] + parts[i + 1])
                if s is not None and (best is None or s > best):
                    best, at = s, i
            if at < 0:
                break
            parts[at : at + 2] = [parts[at] + parts[at + 1]]
        return parts

    def fits(self, a: str, b: str) -> bool:
        """Whether b can follow a in an encoding."""
        if a == UNKNOWN or b == UNKNOWN:
            return True
        known = self.pairs.get((a, b))
        if known is None:
            if len(self.pairs) >= self.cache:
                self.pairs.clear()
            known = self.pairs[a, b] = self._stay_apart(a, b)
        return known

    def _stay_apart(self, left: str, right: str) -> bool:
        """Whether no join across the border comes before the joins that made both pieces.

        The joins are undone from the last one back; at each step the parts that
        meet at the border must have no join of their own that came first.
        """
        rank, made, before = self.rank, self.made, float("inf")
        while True:
            if rank.get(left + right, before) < before:
                return False
            a, b = made.get(left, -1.0), made.get(right, -1.0)
            if a < 0 and b < 0:
                return True
            if a > b:
                before, left = a, self.halves[left][1]
            else:  # of equals the left one came first, and one across the border before the right one
                before, right = b + 1, self.halves[right][0]

    def prefixes(self, text: str, before: str = UNKNOWN) -> tuple[list[str | None], list[int]]:
        """For each prefix of text: its last piece after `before` (None: there is no such chain), and its token count.

        Words share beginnings; what was found for the first HEAD characters is kept.
        """
        n = len(text)
        if before != UNKNOWN or n <= HEAD:
            last: list[str | None] = [before] + [None] * n
            return self.extend(text, last, [0] * (n + 1), 1)
        head = text[:HEAD]
        known = self.heads.get(head)
        if known is None:
            if len(self.heads) >= self.cache // 4:
                self.heads.clear()
            known = self.heads[head] = self.extend(head, [UNKNOWN] + [None] * HEAD, [0] * (HEAD + 1), 1)
        more = n - HEAD
        return self.extend(text, known[0] + [None] * more, known[1] + [0] * more, HEAD + 1)

    def extend(self, text: str, last: list[str | None], count: list[int], at: int) -> tuple[list[str | None], list[int]]:
        """Fills in what prefixes() gives, from prefixes of `at` characters on."""
        endings, pairs = self.endings, self.pairs
        for i in range(at, len(text) + 1):
            node, j = endings, i
            while j and (node := node.get(text[j - 1])):  # one piece at most goes on with a chain, in whatever order they come
                j -= 1
                if "" in node and (prev := last[j]) is not None:
                    piece = node[""]
                    ok = True if prev == UNKNOWN else pairs.get((prev, piece))
                    if ok or ok is None and self.fits(prev, piece):
                        last[i], count[i] = piece, count[j] + 1
                        break
            else:
                if text[i - 1] not in self.ids and last[i - 1] is not None:
                    last[i], count[i] = UNKNOWN, count[i - 1] + len(text[i - 1].encode("utf-8", "surrogatepass"))
        return last, count

    def backtrace(self, text: str, last: list[str | None], end: int, start: int = 0) -> list[int]:
        """Token ids of text[start:end] along the last pieces."""
        out: list[int] = []
        while end > start:
            piece = last[end]
            if piece:
                out.append(self.ids[piece])
                end -= len(piece)
            else:
                end -= 1
                out += [self.byte_ids[b] for b in reversed(text[end].encode("utf-8", "surrogatepass"))]
        return out[::-1]

    def counts_of(self, word: str) -> list[int]:
        """Token count of each prefix, of 1 character and more, of a word behind its mark or marks."""
        return self.prefixes(word)[1][1:]

    def ids_of(self, word: str) -> list[int]:
        return self.backtrace(word, self.prefixes(word)[0], len(word))


_WORDS = re.compile(f"{MARK}+[^{MARK}]*")


def words_of(marked: str) -> list[str]:
    """A marked string as its words, each behind its mark or marks."""
    return [MARK + w for w in marked.split(MARK)[1:]] if MARK * 2 not in marked else _WORDS.findall(marked)


class Kept:
    """What was made of each word, in two generations: what is still in use moves on when the younger one is full.

    many() takes words without their mark; make() gets them with it.
    """

    def __init__(self, make: Callable[[str], bytes], size: int = 250_000):
        self.make, self.size = make, size
        self.young: dict[str, bytes] = {}
        self.old: dict[str, bytes] = {}

    def one(self, word: str) -> bytes:
        made = self.old.get(word)
        if made is None:
            made = self.make(MARK + word)
        if len(word) <= 64:
            if len(self.young) >= self.size:
                self.old, self.young = self.young, {}
            self.young[word] = made
        return made

    def many(self, marked: str) -> list[bytes]:
        """For each word of a marked string."""
        words = marked.split(MARK)[1:] if MARK * 2 not in marked else [w[1:] for w in words_of(marked)]
        got = list(map(self.young.get, words))
        if None in got:
            one, get = self.one, self.young.get
            got = [v if v is not None else get(w) or one(w) for w, v in zip(words, got, strict=True)]
        return got


_MODELS: dict[str, PieceModel] = {}


def model(path: str) -> PieceModel:
    """The model of this Python worker."""
    if path not in _MODELS:
        _MODELS[path] = PieceModel(path)
    return _MODELS[path]
