"""Token counts by a compiled finite-state tokenizer.

A byte-pair tokenizer is a function of bytes that forgets its past quickly, so it can be compiled to a deterministic
transducer: each transition annotates one byte with the change it makes to the number of tokens. Nothing is merged at run
time; counting is one table lookup per byte, many chunks in lockstep.

*State.* For every place at which a token could still be open, the state holds the trie node of the bytes since,
the last token before that place, and the count there relative to here. A token may follow another exactly when no
merge crosses their border (``Transducer.follows``), and a sequence is the tokenizer's own exactly when every two
neighbours may follow. So one open token, and only one, closes at each byte, and the state after it is fixed.

*Pieces.* The tokenizer first splits a text into pieces (contractions, letters, digits, other signs, white space).
Where a piece starts is decided by a bounded look at the classes of the neighbouring characters, so all borders of a batch
are found at once; the transducer restarts there.

*Chunks.* Texts are cut into chunks of equal size, each with a state map (entry state to exit state and count).
A chunk that holds a piece border maps every entry to one exit, so only its head depends on the entry. Maps compose
along the text: the exits of all chunks from an assumed entry are scanned, and chunks whose predecessor turns out to leave
another state are evaluated again at that entry until nothing changes (one extra round in practice; the head of a
chunk is short).

The table is compiled as states are reached and kept per worker; when it holds ``MAX_STATES`` it is emptied, as lazy
automata do, so memory is bounded for any input.
"""

from __future__ import annotations

import json
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame

from speechloom.llm.batches import flat, sliced, worker_cache

CHUNK = 1024
MAX_STATES = 400_000
START = 0
_MARK = 1 << 40

#: Fixed values of the tokenizer's piece pattern: contraction endings.
CONTRACTIONS = ("s", "t", "re", "ve", "m", "ll", "d")


def byte_letters() -> dict[str, int]:
    """The printable letter that stands for each byte in byte-level vocabularies, by the published rule."""
    plain = [*range(ord("!"), ord("~") + 1), *range(ord("¡"), ord("¬") + 1), *range(ord("®"), ord("ÿ") + 1)]
    rest = [b for b in range(256) if b not in set(plain)]
    return {**{chr(b): b for b in plain}, **{chr(256 + i): b for i, b in enumerate(rest)}}


class Transducer:
    """Bytes of a piece to changes of the number of tokens; transitions are made when first asked for."""

    def __init__(self, vocabulary: dict[bytes, int], merges: list[tuple[bytes, bytes]]):
        self.rank: dict[tuple[int, int], int] = {}
        made: dict[int, tuple[int, int, int]] = {}
        for rank, (left, right) in enumerate(merges):
            pair = vocabulary[left], vocabulary[right]
            self.rank.setdefault(pair, rank)
            made.setdefault(vocabulary[left + right], (*pair, rank))
        self.child: dict[int, int] = {}
        self.token, self.inner = [-1], [True]
        self.left, self.right = {}, {}
        for word, token in sorted(vocabulary.items(), key=lambda x: len(x[0])):
            if len(word) > 1 and token not in made:
                continue  # no merge ever makes it
            self.left[token], self.right[token] = self._spine(token, made, 0), self._spine(token, made, 1)
            if len(word) > 1 and not self._reached(*made[token]):
                continue
            node = 0
            for byte in word:
                key = node << 8 | byte
                nxt = self.child.get(key)
                if nxt is None:
                    nxt = self.child[key] = len(self.token)
                    self.token.append(-1)
                    self.inner.append(False)
                    self.inner[node] = True
                node = nxt
            self.token[node] = token
        self._follows: dict[tuple[int, int], bool] = {}
        self.empty()

    @staticmethod
    def _spine(token: int, made: dict, side: int) -> list[tuple[int, float]]:
        """The symbols that stand at one edge of a token over time, each with the rank at which it is merged away."""
        spine, gone = [(token, float("inf"))], made.get(token)
        while gone:
            token = gone[side]
            spine.append((token, gone[2]))
            gone = made.get(token)
        return spine

    def _crossed(self, left: int, right: int, below: float) -> bool:
        """Whether some merge of lower rank joins symbols over the border of two neighbouring tokens."""
        for a, a_gone in self.right[left]:
            for b, b_gone in self.left[right]:
                rank = self.rank.get((a, b))
                # Of equal ranks the leftmost merge comes first: before the border it wins, behind it loses.
                if rank is not None and rank < below and rank < a_gone and rank <= b_gone:
                    return True
        return False

    def _reached(self, left: int, right: int, rank: int) -> bool:
        return left in self.right and right in self.left and not self._crossed(left, right, rank)

    def follows(self, left: int, right: int) -> bool:
        key = left, right
        known = self._follows.get(key)
        if known is None:
            known = self._follows[key] = not self._crossed(left, right, float("inf"))
        return known

    def empty(self) -> None:
        """Forget all transitions. Untouched pages of the table take no memory."""
        self.table = np.zeros(MAX_STATES * 256, np.int32)  # 0: not made yet; else state << 8 | change + 128
        first = ((0, -1, 0),)
        self.states, self.keys = {first: START}, [first]

    def make(self, state: int, byte: int) -> None:
        opened, closed = [], None
        for node, last, count in self.keys[state]:
            node = self.child.get(node << 8 | byte)
            if node is None:
                continue
            token = self.token[node]
            if token >= 0 and (last < 0 or self.follows(last, token)):
                closed = token, count + 1
            if self.inner[node]:
                opened.append((node, last, count))
        token, change = closed
        key = (*((node, last, count - change) for node, last, count in opened), (0, token, 0))
        number = self.states.get(key)
        if number is None:
            number = self.states[key] = len(self.keys)
            self.keys.append(key)
        self.table[state << 8 | byte] = number << 8 | change + 128

    def step(self, states: np.ndarray, data: np.ndarray) -> np.ndarray:
        """Entries of the table for states and the bytes read in them."""
        at = (states << 8) | data
        entry = self.table[at]
        missing = entry == 0
        if missing.any():
            for key in np.unique(at[missing]).tolist():
                self.make(key >> 8, key & 255)
            entry = self.table[at]
        return entry


def compiled(path: str) -> tuple[Transducer, list[str]]:
    """The transducer of a byte-level BPE file, kept per worker, and its added tokens."""
    cache = worker_cache()
    if ("transducer", path) not in cache:
        with open(path, encoding="utf-8") as file:
            spec = json.load(file)
        letters, model = byte_letters(), spec["model"]
        as_bytes = lambda word: bytes(letters[c] for c in word)
        merges = [tuple(map(as_bytes, m.split(" ") if isinstance(m, str) else m)) for m in model["merges"]]
        added = [x["content"] for x in spec["added_tokens"]]
        vocabulary = {as_bytes(w): i for w, i in model["vocab"].items() if w not in added}
        cache["transducer", path] = Transducer(vocabulary, merges), added
    return cache["transducer", path]


def char_classes() -> np.ndarray:
    """Class of each code point for the piece pattern: 0 other, 1 letter, 2 number, 3 white space, 4 the blank."""
    cache = worker_cache()
    if "classes" not in cache:
        import regex

        points = [c for c in range(0x110000) if not 0xD800 <= c < 0xE000]
        text = "".join(map(chr, points))
        place, classes = np.array(points), np.zeros(0x110000, np.uint8)
        for kind, pattern in ((1, r"\p{L}+"), (2, r"\p{N}+"), (3, r"\s+")):
            for found in regex.finditer(pattern, text):
                classes[place[found.start(): found.end()]] = kind
        classes[0x20] = 4
        cache["classes"] = classes
    return cache["classes"]


def piece_starts(data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """Whether a piece starts at each byte. ``offsets`` bound the stretches that are split on their own."""
    lead = (data & 0xC0) != 0x80
    places = np.flatnonzero(lead)
    points = np.frombuffer(data.tobytes().decode("utf-8").encode("utf-32-le"), np.uint32)
    kind = char_classes()[points]
    n = len(kind)
    opens = np.zeros(n + 1, bool)
    opens[np.searchsorted(places, offsets)] = True
    begins, ends = opens[:-1], opens[1:].copy()
    ends[-1:] = True
    space = kind >= 3
    before = np.empty_like(kind)
    before[1:], before[:1] = kind[:-1], 0
    behind_space = np.zeros(n, bool)
    behind_space[1:] = space[:-1]
    next_space = np.ones(n, bool)
    next_space[:-1] = space[1:]
    # White space: a run starts a piece, and so does its last character where something follows it.
    starts = space & (~behind_space | (~next_space & ~ends))
    starts |= ~space & np.where(behind_space, before != 4, kind != before)
    starts |= begins
    # Contractions: an apostrophe that opens a piece takes its ending along.
    marks = np.flatnonzero((points == 0x27) & starts)
    if len(marks):
        stretch = np.searchsorted(np.flatnonzero(begins), marks, "right")
        limits = np.append(np.flatnonzero(begins), n)[stretch]
        tail = np.append(points, [0, 0])
        for word in CONTRACTIONS:
            hit = marks + len(word) < limits
            for j, letter in enumerate(word, 1):
                hit &= tail[np.minimum(marks + j, n)] == ord(letter)
            at = marks[hit]
            starts[at + 1] = False
            after = at + 1 + len(word)
            inside = after < limits[hit]
            starts[after[inside]] = True
    out = np.zeros(len(data), bool)
    out[places[starts]] = True
    return out


def run_chunks(machine: Transducer, data: np.ndarray, starts: np.ndarray, begin: np.ndarray, end: np.ndarray,
               entry: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Exit state and count of chunks entered in given states, all in lockstep; longer chunks first."""
    order = np.argsort(begin - end, kind="stable")
    begin, length = begin[order], (end - begin)[order]
    states, counts = entry[order].astype(np.int64), np.zeros(len(order), np.int64)
    steps = int(length[0]) if len(length) else 0
    live = np.searchsorted(-length, -np.arange(steps), "left")
    for k in range(steps):
        m = live[k]
        at = begin[:m] + k
        # A start of a piece leaves START whatever the state was.
        got = machine.step(np.where(starts[at], START, states[:m]), data[at])
        states[:m] = got >> 8
        counts[:m] += (got & 255) - 128
    back = np.empty_like(order)
    back[order] = np.arange(len(order))
    return states[back], counts[back]


def count_stretches(machine: Transducer, data: np.ndarray, bounds: np.ndarray) -> np.ndarray:
    """Tokens of each stretch ``bounds[i]:bounds[i + 1]`` of the data, through the state maps of its chunks."""
    if not len(data):
        return np.zeros(len(bounds) - 1, np.int64)
    if len(machine.keys) > MAX_STATES // 2:
        machine.empty()
    starts = piece_starts(data, bounds[:-1])
    size = np.diff(bounds)
    per = -(-size // CHUNK)
    rows = np.repeat(np.arange(len(size)), per)
    place = np.arange(len(rows)) - np.repeat(np.cumsum(per) - per, per)
    begin = bounds[:-1][rows] + place * CHUNK
    end = np.minimum(begin + CHUNK, bounds[1:][rows])
    first = place == 0
    # The head of a chunk, up to its first piece border, is all that its map takes from the entry state.
    marks = np.flatnonzero(starts)
    head = np.minimum(np.append(marks, len(data))[np.searchsorted(marks, begin)], end)
    exits, counts = run_chunks(machine, data, starts, head, end, np.zeros(len(begin), np.int64))
    settled = head < end  # the exit does not depend on the entry
    entry = np.full(len(begin), START, np.int64)
    headed = head > begin
    exits = np.where(settled | first, exits, START)
    head_counts = np.zeros(len(begin), np.int64)
    todo = np.flatnonzero(headed)
    while len(todo):
        entry[todo] = np.where(first[todo], START, exits[np.maximum(todo - 1, 0)])
        out, got = run_chunks(machine, data, starts, begin[todo], head[todo], entry[todo])
        head_counts[todo] = got
        through = ~settled[todo]
        exits[todo[through]] = out[through]
        # Entries that were assumed wrongly: those behind a chunk that is one stretch without a border.
        wrong = headed & ~first
        wrong[1:] &= entry[1:] != exits[:-1]
        todo = np.flatnonzero(wrong)
    return np.bincount(rows, counts + head_counts, len(size)).astype(np.int64)


def count_batch(path: str, texts: pa.Array) -> np.ndarray:
    """Tokens of each text; null counts as empty."""
    machine, added = compiled(path)
    data, offsets = flat(texts)
    raw = data.tobytes()
    cuts, owner = [], []
    for word in added:
        mark = word.encode()
        at = raw.find(mark)
        while at >= 0:
            doc = int(np.searchsorted(offsets, at, "right")) - 1
            if at + len(mark) <= offsets[doc + 1]:
                cuts.append((at, at + len(mark)))
                owner.append(doc)
                at = raw.find(mark, at + len(mark))
            else:
                at = raw.find(mark, at + 1)
    bounds = np.unique(np.concatenate([offsets, np.array(cuts, np.int64).reshape(-1)]))
    counts = count_stretches(machine, data, bounds)
    # A special token is one token, whatever its letters would give.
    special = np.isin(bounds[:-1], [a for a, _ in cuts])
    counts[special] = 1
    running = np.concatenate([[0], np.cumsum(counts)])
    at = np.searchsorted(bounds, offsets)
    return running[at[1:]] - running[at[:-1]]


def token_counts(docs: DataFrame, path: str, limit: int = 512, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``doc_id, n_bytes, n_tokens, over_limit`` of every text, counted as the tokenizer file at ``path`` would.

    Null and empty texts have 0 bytes and 0 tokens. Repeated rows and null ids are counted row by row; other columns
    are not read. An empty table gives no rows. No shuffle; a text of any length is cut into chunks.
    """

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in sliced(batches, "_text"):
            texts = batch.column("_text")
            tokens = count_batch(path, texts)
            sizes = pc.fill_null(pc.binary_length(texts), 0).cast(pa.int64())
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), sizes, pa.array(tokens), pa.array(tokens > limit)],
                names=["doc_id", "n_bytes", "n_tokens", "over_limit"])

    narrow = docs.select(docs[id_col].cast("bigint").alias("doc_id"), docs[text_col].cast("string").alias("_text"))
    return narrow.mapInArrow(count, "doc_id bigint, n_bytes bigint, n_tokens bigint, over_limit boolean")
