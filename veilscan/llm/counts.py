"""Token counts of a sentencepiece BPE model by a compiled finite-state transducer.

BPE has a token that ends the encoding of each prefix of a text, and which one depends on little: token t ends the
prefix if t is a suffix of it and t may follow the token that ends the prefix before t, that is if the two encode to themselves. So reading
left to right, a state needs, for each suffix that may still grow into a piece, its place in the pieces' trie, the last
token before it, and the tokens there minus the tokens here. These states are finite; they are compiled when first met. A transition carries the number of
tokens that it adds, and the count of a text is the sum along its path.

A chunk of text is a map of states. Where a boundary lies in it (a blank after a non-blank, as no piece has one inside; a character
without a piece), the state behind it is the start state whatever came before, so a chunk's map is short: the text up to its first boundary,
the count from there, and its last stretch. Maps compose, and composition is associative; a long text's chunks are composed
pairwise like a prefix scan. The map from boundary to boundary, a word mostly, is kept.

* Null texts count as empty, empty texts have no tokens. Texts are counted whole. Repeated rows are counted alike.
* Begin, end and control pieces inside texts are ordinary characters. Other columns are not read. Nothing is shuffled.
"""

from __future__ import annotations

import re

import public_tokenizers
import pyarrow as pa
import sentencepiece
from pyspark.sql import DataFrame

MODEL = "piece_bpe_32k.model"
BLANK = "▁"
LIMIT = 4096
#: Characters in a chunk, and stretches that a Python worker keeps with their longest length.
CHUNK = 1 << 16
KEPT = 400_000
KEPT_LENGTH = 64
#: States and transitions compiled at most; then compilation starts anew.
COMPILED = 1_000_000


class Transducer:
    """The compiled tokenizer. Tokens are numbers by falling score: the least number of a pair's merge merges first."""

    def __init__(self, pieces: list[tuple[str, float]]):
        order = sorted(pieces, key=lambda p: -p[1])
        self.number = {piece: k for k, (piece, _) in enumerate(order)}
        self.text = [piece for piece, _ in order]
        self.single = {p for p in self.number if len(p) == 1}
        # the pieces' trie: node -> char -> node; the piece that ends at a node, else -1
        self.child: list[dict[str, int]] = [{}]
        self.ends = [-1]
        for piece, k in self.number.items():
            if self._merged(piece) != [piece]:
                continue  # never the encoding of its own text, so never in any encoding
            node = 0
            for char in piece:
                if char not in self.child[node]:
                    self.child[node][char] = len(self.child)
                    self.child.append({})
                    self.ends.append(-1)
                node = self.child[node][char]
            self.ends[node] = k
        self.follows: dict[tuple[int, int], bool] = {}
        self._forget()

    def _forget(self) -> None:
        #: states: active suffixes (trie node, last token before it, tokens there minus tokens here); 0 is the start
        self.states: list[tuple] = [((0, -1, 0),)]
        self.known = {self.states[0]: 0}
        self.steps: list[dict[str, tuple[int, int]]] = [{}]
        self.compiled = 0

    def _merged(self, text: str) -> list[str]:
        """BPE of a short text by its definition."""
        parts = list(text)
        while len(parts) > 1:
            ranks = [self.number.get(a + b, len(self.number)) for a, b in zip(parts, parts[1:], strict=False)]
            least = min(ranks)
            if least == len(self.number):
                break
            k = ranks.index(least)
            parts[k : k + 2] = [parts[k] + parts[k + 1]]
        return parts

    def _may_follow(self, a: int, b: int) -> bool:
        if a < 0:
            return True
        pair = a, b
        if pair not in self.follows:
            if len(self.follows) > COMPILED:
                self.follows.clear()
            self.follows[pair] = self._merged(self.text[a] + self.text[b]) == [self.text[a], self.text[b]]
        return self.follows[pair]

    def _compile(self, state: int, char: str) -> tuple[int, int]:
        last, added, grown = -1, 0, []
        for node, before, behind in self.states[state]:
            node = self.child[node].get(char, -1)
            if node < 0:
                continue
            token = self.ends[node]
            if token >= 0 and last < 0 and self._may_follow(before, token):
                last, added = token, behind + 1
            if self.child[node]:
                grown.append((node, before, behind))
        if last < 0:
            raise ValueError(f"no piece ends at {char!r}: the model is no BPE model with all its characters as pieces")
        new = (*[(node, before, behind - added) for node, before, behind in grown], (0, last, 0))
        if new not in self.known:
            self.known[new] = len(self.states)
            self.states.append(new)
            self.steps.append({})
        self.steps[state][char] = step = self.known[new], added
        self.compiled += 1
        return step

    def run(self, text: str) -> int:
        """Tokens of a text of known characters that starts at a boundary."""
        if self.compiled > COMPILED:
            self._forget()
        state, total, steps = 0, 0, self.steps
        for char in text:
            step = steps[state].get(char)
            if step is None:
                step = self._compile(state, char)
            state = step[0]
            total += step[1]
        return total


class Counter:
    """Counts of texts, for one model file."""

    def __init__(self, path: str):
        model = sentencepiece.SentencePieceProcessor(model_file=path)
        special = lambda i: model.is_control(i) or model.is_unknown(i) or model.is_byte(i) or model.is_unused(i)
        pieces = [(model.id_to_piece(i), model.get_score(i)) for i in range(model.get_piece_size()) if not special(i)]
        if any(BLANK in p.lstrip(BLANK) for p, _ in pieces) or not any(map(model.is_byte, range(model.get_piece_size()))):
            raise ValueError("pieces with a blank inside, or no byte pieces: not this kind of model")
        if model.encode("a", out_type=str)[0][0] != BLANK:
            raise ValueError("the model puts no blank before a text")
        self.transducer = Transducer(pieces)
        #: a stretch from boundary to boundary: blanks and what follows; line ends, which have no piece, are boundaries of their own
        self.stretch = re.compile(f"{BLANK}+[^{BLANK}\n]*|[^{BLANK}\n]+|\n")
        self.kept: dict[str, int] = {}

    def _stretch(self, text: str) -> int:
        """Tokens of a stretch; characters without a piece are as many tokens as bytes and boundaries."""
        single, total, begin = self.transducer.single, 0, 0
        for k, char in enumerate(text):
            if char not in single:
                total += self.transducer.run(text[begin:k]) + len(char.encode())
                begin = k + 1
        return total + self.transducer.run(text[begin:])

    def _sum(self, stretches: list[str]) -> int:
        kept = self.kept
        try:
            return sum([kept[s] for s in stretches])
        except KeyError:
            pass
        total = 0
        for s in stretches:
            n = kept.get(s)
            if n is None:
                n = self._stretch(s)
                if len(s) <= KEPT_LENGTH:
                    if len(kept) >= KEPT:
                        kept.clear()
                    kept[s] = n
            total += n
        return total

    def chunk_map(self, chunk: str) -> tuple[str, int, str | None]:
        """(text up to the first boundary, tokens between the first and last one, text behind the last one; null without a boundary)."""
        stretches = self.stretch.findall(chunk)
        if len(stretches) < 2:
            return chunk, 0, None
        return stretches[0], self._sum(stretches[1:-1]), stretches[-1]

    def compose(self, a: tuple[str, int, str | None], b: tuple[str, int, str | None]) -> tuple[str, int, str | None]:
        """The map of one chunk and then the other. What meets between them is cut into stretches again."""
        if b[2] is None:
            x, n, y = self.chunk_map((a[0] if a[2] is None else a[2]) + b[0])
            return (x, n, y) if a[2] is None else (a[0], a[1], x) if y is None else (a[0], a[1] + self._sum([x]) + n, y)
        x, n, y = self.chunk_map((a[0] if a[2] is None else a[2]) + b[0])
        if a[2] is None:
            return (x, b[1], b[2]) if y is None else (x, n + self._sum([y]) + b[1], b[2])
        return a[0], a[1] + n + self._sum([x] if y is None else [x, y]) + b[1], b[2]

    def count(self, text: str) -> int:
        if not text:
            return 0
        text = BLANK + text.replace(" ", BLANK)
        if len(text) <= CHUNK:
            return self._sum(self.stretch.findall(text))
        maps = [self.chunk_map(text[k : k + CHUNK]) for k in range(0, len(text), CHUNK)]
        while len(maps) > 1:
            maps = [self.compose(*maps[k : k + 2]) if k + 1 < len(maps) else maps[k] for k in range(0, len(maps), 2)]
        head, between, tail = maps[0]
        return self._sum([head]) + between + (self._sum([tail]) if tail else 0)


_LOADED: dict[str, Counter] = {}


def counter(path: str) -> Counter:
    """The counter of this Python worker, built once."""
    if path not in _LOADED:
        _LOADED[path] = Counter(path)
    return _LOADED[path]


def counted(docs: DataFrame, path: str = "", limit: int = LIMIT) -> DataFrame:
    """doc_id, n_bytes, n_tokens, over_limit of each row."""

    def rows(batches):
        count = counter(path or public_tokenizers.path(MODEL)).count
        for batch in batches:
            sizes, tokens = [], []
            for text in batch.column(1):
                text = text.as_py() or ""
                sizes.append(len(text.encode()))
                tokens.append(count(text))
            columns = [batch.column(0), pa.array(sizes, pa.int64()), pa.array(tokens, pa.int64()), pa.array([n > limit for n in tokens], pa.bool_())]
            yield pa.RecordBatch.from_arrays(columns, ["doc_id", "n_bytes", "n_tokens", "over_limit"])

    kind = dict(docs.dtypes)["doc_id"]
    return docs.select("doc_id", "text").mapInArrow(rows, f"doc_id {kind}, n_bytes bigint, n_tokens bigint, over_limit boolean")
