"""Token counts that follow edits without encoding the whole text again.

A document is cut into leaves of some pre-tokens each; a segment tree keeps characters
and tokens under each node. Pre-tokens are matched from left to right and look at most
two characters ahead, so an edit changes no pre-token that ends two characters before it,
and none after the first old boundary behind it that is also a new one. Only the leaves
in between are encoded again, and the sums above them updated.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from fitgrain.llm.common import slices
from fitgrain.llm.tokens import OTHER, PRE_TOKEN, Encoder, default_path, encoder

LEAF = 64
#: Characters of a pre-token, about; and where a leaf may end.
LETTERS = 6
CUT = re.compile(r"(?<=\S) (?=[^\W\d_])")
#: A leaf of so many times the pre-tokens makes the tree be laid out anew.
LARGE = 4
INTS = T.ArrayType(T.IntegerType())
EDITS = "array<struct<start:int,stop:int,text:string>>"


class CountTree:
    """A segment tree in two lists: node 1 is the root, the leaves are the last half."""

    def __init__(self, chars: list[int], tokens: list[int]):
        self.chars, self.tokens = chars, tokens

    @classmethod
    def of_leaves(cls, leaves: list[tuple[int, int]]) -> CountTree:
        width = 1
        while width < len(leaves):
            width *= 2
        out = cls([0] * (2 * width), [0] * (2 * width))
        for i, (c, t) in enumerate(leaves):
            out.chars[width + i], out.tokens[width + i] = c, t
        for i in range(width - 1, 0, -1):
            out._add_up(i)
        return out

    def _add_up(self, i: int) -> None:
        self.chars[i] = self.chars[2 * i] + self.chars[2 * i + 1]
        self.tokens[i] = self.tokens[2 * i] + self.tokens[2 * i + 1]

    @property
    def width(self) -> int:
        return len(self.chars) // 2

    @property
    def total(self) -> int:
        return self.tokens[1]

    def leaf_at(self, place: int) -> tuple[int, int]:
        """The leaf with the character at ``place``, or the last one, and where it starts."""
        i, start = 1, 0
        while i < self.width:
            left = self.chars[2 * i]
            # Empty leaves on the right are never entered.
            if place < start + left or not self.chars[2 * i + 1]:
                i = 2 * i
            else:
                start += left
                i = 2 * i + 1
        return i - self.width, start

    def put(self, leaf: int, chars: int, tokens: int) -> None:
        i = self.width + leaf
        self.chars[i], self.tokens[i] = chars, tokens
        while i > 1:
            i //= 2
            self._add_up(i)


def _spans(encode: Encoder, text: str, start: int) -> Iterator[str]:
    """Pre-tokens from a boundary on."""
    if OTHER.search(text, start):
        yield from encode.pre_tokens(text[start:])
    else:
        yield from (m.group() for m in PRE_TOKEN.finditer(text, start))


def _leaves(encode: Encoder, pieces: list[str], size: int) -> list[tuple[int, int]]:
    """Characters and tokens of runs of pre-tokens. Cut at the ends of pre-tokens, a run
    has the same pre-tokens alone."""
    runs = ("".join(pieces[i : i + size]) for i in range(0, len(pieces), size))
    return [(len(run), encode.count(run)) for run in runs]


def build(encode: Encoder, text: str, leaf: int = LEAF) -> CountTree:
    """A tree whose leaves are cut where a space follows another character and comes
    before a letter: a pre-token begins there in any text."""
    if OTHER.search(text):
        return CountTree.of_leaves(_leaves(encode, encode.pre_tokens(text), leaf))
    cuts, place = [0], 0
    while (found := CUT.search(text, place + leaf * LETTERS)) is not None:
        place = found.start()
        cuts.append(place)
    cuts.append(len(text))
    runs = (text[i:j] for i, j in zip(cuts, cuts[1:]) if j > i)
    return CountTree.of_leaves([(len(run), len(encode.ranks.encode_ordinary(run))) for run in runs])


def edit(
    encode: Encoder, tree: CountTree, text: str, start: int, stop: int, new: str, leaf: int = LEAF
) -> tuple[CountTree, str, int]:
    """The tree and text after characters start to stop - 1 gave way to ``new``, and the
    number of characters that were encoded again."""
    start = min(max(start, 0), len(text))
    stop = min(max(stop, start), len(text))
    after = text[:start] + new + text[stop:]
    grown = len(after) - len(text)
    first, begin = tree.leaf_at(max(start - 2, 0))
    last, at = tree.leaf_at(max(stop - 1, 0))
    end = at + tree.chars[tree.width + last]
    pieces, place = [], begin
    if len(after) > begin:
        for piece in _spans(encode, after, begin):
            # A boundary of the old text behind the edit: all that follows is as before.
            while end < stop or end + grown < place:
                last += 1
                end += tree.chars[tree.width + last]
            if place == end + grown and place >= start + len(new):
                break
            pieces.append(piece)
            place += len(piece)
        else:
            last = tree.width - 1
    else:
        last = tree.width - 1
    slots = last - first + 1
    size = max(leaf, -(-len(pieces) // slots))
    fresh = _leaves(encode, pieces, size)
    if size > LARGE * leaf:
        old = list(zip(tree.chars[tree.width :], tree.tokens[tree.width :]))
        fresh = _leaves(encode, pieces, leaf)
        kept = [x for x in old[:first] + fresh + old[last + 1 :] if x[0]]
        return CountTree.of_leaves(kept), after, place - begin
    for i in range(slots):
        tree.put(first + i, *(fresh[i] if i < len(fresh) else (0, 0)))
    return tree, after, place - begin


def build_counts(
    docs: DataFrame, text: str = "text", path: str | None = None, leaf: int = LEAF
) -> DataFrame:
    """The documents and their trees, ``chars`` and ``tokens``, and ``n_tokens``.

    Strings of special tokens in a text are ordinary text. Null and empty texts have no
    tokens. Repeated rows and null ids are counted like any others. Other columns are
    passed on; those called like the new ones are replaced. An empty table gives no rows.
    """
    path = path or default_path()
    names = [c for c in docs.columns if c not in ("chars", "tokens", "n_tokens")]

    def count(batches):
        encode = encoder(path, plain=True)
        for whole in batches:
            for batch in slices(whole, text):
                trees = [build(encode, t or "", leaf) for t in batch[text].to_pylist()]
                yield pa.RecordBatch.from_arrays(
                    [
                        *(batch[c] for c in names),
                        pa.array([t.chars for t in trees], pa.list_(pa.int32())),
                        pa.array([t.tokens for t in trees], pa.list_(pa.int32())),
                        pa.array([t.total for t in trees], pa.int64()),
                    ],
                    names=[*names, "chars", "tokens", "n_tokens"],
                )

    schema = docs.select(*names).schema
    for name, kind in (("chars", INTS), ("tokens", INTS), ("n_tokens", T.LongType())):
        schema = schema.add(name, kind)
    return docs.select(*names).mapInArrow(count, schema)


def apply_edits(
    counted: DataFrame,
    edits: str = "edits",
    text: str = "text",
    path: str | None = None,
    leaf: int = LEAF,
) -> DataFrame:
    """``counted`` after its rows' edits, with ``n_encoded``.

    ``edits`` is an array of ``start, stop, text``, applied in turn, each on what the one
    before left; places outside the text are moved to its ends, and a null edit does
    nothing. ``n_encoded`` is the number of characters that were encoded again.
    """
    path = path or default_path()
    drop = ("chars", "tokens", "n_tokens", "n_encoded", text, edits)
    names = [c for c in counted.columns if c not in drop]

    def update(batches):
        encode = encoder(path, plain=True)
        for whole in batches:
            for batch in slices(whole, text):
                rows = [batch[c].to_pylist() for c in (text, "chars", "tokens", edits)]
                out: list[list] = [[], [], [], [], []]
                for string, chars, tokens, steps in zip(*rows):
                    tree, string, done = CountTree(chars, tokens), string or "", 0
                    for step in steps or ():
                        if step is None:
                            continue
                        start, stop = step["start"] or 0, step["stop"] or 0
                        tree, string, n = edit(
                            encode, tree, string, start, stop, step["text"] or "", leaf
                        )
                        done += n
                    row = (string, tree.chars, tree.tokens, tree.total, done)
                    for values, value in zip(out, row):
                        values.append(value)
                ints = pa.list_(pa.int32())
                kinds = (pa.string(), ints, ints, pa.int64(), pa.int64())
                yield pa.RecordBatch.from_arrays(
                    [*(batch[c] for c in names), *map(pa.array, out, kinds)],
                    names=[*names, text, "chars", "tokens", "n_tokens", "n_encoded"],
                )

    schema = counted.select(*names).schema
    kinds = (T.StringType(), INTS, INTS, T.LongType(), T.LongType())
    for name, kind in zip((text, "chars", "tokens", "n_tokens", "n_encoded"), kinds):
        schema = schema.add(name, kind)
    kept = counted.select(*names, text, "chars", "tokens", F.col(edits).cast(EDITS).alias(edits))
    return kept.mapInArrow(update, schema)
