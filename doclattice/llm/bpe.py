"""Byte-pair encoding by a tokenization automaton, and token counts.

The automaton over tokens accepts exactly those token sequences that the merge
list yields for the text that they spell. It is compiled from one state with a
loop for every base symbol, by one gadget per merge, in merge order. The gadget
of a merge (a, b) sends the arcs labelled a to a copy of their target that lacks
the arc b, and lets every state with an arc a have an arc ab to where b led from
there.

All arcs with one label lead to one state, so a state is named by the token that
enters it. A copy differs from what it was copied from by one missing arc, so
states are stored as such differences: state(t) = state(right half of t) as it
was when t was made, less the arcs removed later. Hence the overlay rows are one
for each merge (49,000), where the full table would have 49,000 x 49,000 arcs,
and an arc u leaves state(t) unless some merge (x, y) with x on the right spine
of t and y on the left spine of u came before the merges that grow x and y
further.

Words are read symbol by symbol, by the automaton of the trie of tokens with
failure links: its state is the longest end of what was read that begins a token,
and names the tokens that end there. Its transitions beyond the trie are found as
words ask for them and kept (bounded, see MOST: when the table is full it starts
anew, which changes the speed only). Every prefix of a word is spelled by exactly
one accepted sequence, so of the tokens that end at a place exactly one is an arc
out of the state in which the symbols before it ended: one table step for each
symbol, nothing is tried and taken back, and the tokens are read off from the end
of the word by their lengths. Decoding emits the labels of the arcs.

What lies between white space, and the pieces of it, are looked up in tables of
what the worker has encoded before. The tables are bounded (see Known); they
change the speed only.

Parts of texts with characters on which the library's Unicode tables differ from
Python's and regex's are normalised and split by the library's own parts (see
odd_characters); the merges are the automaton's in any case.

Handling, for encode_column, decode_column, round_trip_column and count_column:
a null text counts as empty and has no tokens (decoding: null for null). Texts of
any length are read whole; words of any length too, as the tables' bounds hold
within a word. Repeated rows stay rows of their own with equal values; nothing
is ordered, so ties play no part. Empty tables give no rows. Other columns pass
through, but for columns named like a new one, which are replaced.
"""

from __future__ import annotations

import gc
import heapq
import json
import os
import re
import unicodedata
from array import array

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import regex
from pyspark.sql import DataFrame

from doclattice.llm.common import lean
from doclattice.llm.odd_characters import Library, odd_characters

#: White space of Unicode, as the tokenizer files' patterns see it.
SPACES = r"\t-\r \x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000"
#: Characters that Python's split() takes for white space besides these.
ODD = re.compile("[\x1c-\x1f]")
CHUNK = re.compile(f"[^{SPACES}]+")
RUN = re.compile(f"[{SPACES}]{{2}}")
LONE = re.compile(f"(?<=[^{SPACES}]) (?=[^{SPACES}])")


def byte_labels() -> list[str]:
    """The printable character that stands for each byte in byte-level vocabularies."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    labels, extra = {b: chr(b) for b in plain}, 256
    for b in range(256):
        if b not in labels:
            labels[b] = chr(extra)
            extra += 1
    return [labels[b] for b in range(256)]


class Arcs(dict):
    """Whether an arc leaves the state of a token, by the arc's token, as far as it was asked for. No token (-1): the start, which all leave."""

    __slots__ = ("automaton", "token")

    def __init__(self, automaton: Automaton, token: int) -> None:
        self.automaton, self.token = automaton, token

    def __missing__(self, u: int) -> bool:
        if self.token < 0:
            return True
        stays = self[u] = self.automaton.stays(self.token, u)
        self.automaton.asked += 1
        return stays


class Place(dict):
    """A state of the symbol automaton: transitions by symbol, as far as they were asked for, and the tokens of two symbols and more that end here."""

    __slots__ = ("automaton", "found", "node")

    def __init__(self, automaton: Automaton, node: int) -> None:
        self.automaton, self.node, self.found = automaton, node, automaton.found[node]

    def __missing__(self, code: int) -> Place:
        return self.automaton.step(self, code)


class Automaton:
    """merges: pairs of token strings in order of rank. suffix: what ends the last symbol of a word."""

    def __init__(self, merges: list[tuple[str, str]], suffix: str = "") -> None:
        self.suffix = suffix
        self.removed: dict[tuple[str, str], int] = {}
        self.halves: dict[str, tuple[str, str, int]] = {}
        self.made = {a + b for a, b in merges}
        for time, (a, b) in enumerate(merges):
            self.gadget(a, b, time)
        self.start = Arcs(self, -1)
        self.states: dict[int, Arcs] = {}
        self.asked = 0
        self.left = None
        self.tokens: list[str] = []
        self.sizes: list[int] = []
        self.symbols: dict[str, int] = {}
        self.trie: dict[int, int] = {}
        self.ends = [-1]
        split: dict[str, list[str]] = {}
        for t, (a, b, _) in self.halves.items():
            split[t] = split.get(a, [a]) + split.get(b, [b])
        for t in sorted({x for symbols in split.values() for x in symbols} - split.keys()):
            self.add(t, [t])
        for t, symbols in split.items():
            self.add(t, symbols)
        # From here on tokens go by number, and the gadgets' removed arcs and the halves with them.
        numbers = {t: k for k, t in enumerate(self.tokens)}
        self.times = {numbers[a] << 32 | numbers[b]: time for (a, b), time in self.removed.items() if a in numbers and b in numbers}
        halves = [self.halves.get(t) for t in self.tokens]
        self.left = array("q", [numbers[h[0]] if h else -1 for h in halves])
        self.right = array("q", [numbers[h[1]] if h else -1 for h in halves])
        self.born = array("q", [h[2] if h else 1 << 60 for h in halves])
        del self.removed, self.halves, self.made
        self.labels = byte_labels()
        self.link()
        self.alone = [self.ends[self.trie[code]] for code in range(len(self.symbols))]
        self.root, self.moves, self.kept = Place(self, 0), {}, 0
        # The code of each byte within a word and at its end.
        for c in self.labels:
            for s in (c, c + suffix):
                if s not in self.symbols:
                    self.add(s, [s])
        self.within = [self.symbols[c] for c in self.labels]
        self.at_end = [self.symbols[c + suffix] for c in self.labels]

    def gadget(self, a: str, b: str, time: int) -> None:
        """state(a) loses the arc b; the token ab enters what b entered. Without an arc b there, nothing happens."""
        stands = a + b not in self.halves and all(x in self.halves or x not in self.made for x in (a, b)) and self.arc_at(a, b)
        self.removed.setdefault((a, b), time)
        if stands:
            self.halves[a + b] = (a, b, time)

    def spine(self, token: str, side: int) -> list[tuple[str, int]]:
        """The token, its half on that side, that one's half and so on, each with the time until which it stood alone."""
        out, until = [(token, 1 << 60)], 1 << 60
        while (made := self.halves.get(token)) is not None:
            token, until = made[side], made[2]
            out.append((token, until))
        return out

    def arc_at(self, t: str, u: str) -> bool:
        """As has_arc, after the gadgets so far. Of equal merges the left one comes first."""
        ys = self.spine(u, 0)
        return all(
            (time := self.removed.get((x, y))) is None or time >= x_until or time > y_until
            for x, x_until in self.spine(t, 1)
            for y, y_until in ys
        )

    #: Most arcs that are kept.
    MOST_ARCS = 150_000

    def state(self, t: int) -> Arcs:
        """The state that a token enters."""
        if self.asked >= self.MOST_ARCS:
            self.states.clear()
            self.asked = 0
        state = self.states[t] = Arcs(self, t)
        return state

    def stays(self, t: int, u: int) -> bool:
        """Whether the arc u leaves state(t), tokens by number. As arc_at, after all gadgets."""
        times, left, right, born = self.times, self.left, self.right, self.born
        x, x_until = t, 1 << 60
        while x >= 0:
            y, y_until = u, 1 << 60
            while y >= 0:
                time = times.get(x << 32 | y)
                if time is not None and time < x_until and time <= y_until:
                    return False
                y, y_until = left[y], born[y]
            x, x_until = right[x], born[x]
        return True

    def add(self, token: str, symbols: list[str]) -> None:
        """The token's path in the trie: from a node, by the number of a symbol, to a node."""
        node = 0
        for s in symbols:
            key = node << 20 | self.symbols.setdefault(s, len(self.symbols))
            if key not in self.trie:
                self.trie[key] = len(self.ends)
                self.ends.append(-1)
            node = self.trie[key]
        self.ends[node] = len(self.tokens)
        self.tokens.append(token)
        self.sizes.append(len(symbols))
        if self.left is not None:  # a symbol that no merge has
            for half in (self.left, self.right):
                half.append(-1)
            self.born.append(1 << 60)
            self.alone.append(self.ends[node])
            self.fails.append(0)
            self.found.append(())

    def link(self) -> None:
        """Failure links of the trie's nodes, shorter ones first, and the tokens of two symbols and more that end at each node, as (number of symbols, token), the longest first."""
        n = len(self.ends)
        depth, above, of = [0] * n, array("l", [0]) * n, array("l", [0]) * n
        for key, node in self.trie.items():  # a node comes after the one above it
            above[node], of[node] = key >> 20, key & 0xFFFFF
            depth[node] = depth[key >> 20] + 1
        self.fails, self.found = array("l", [0]) * n, [()] * n
        for node in sorted(range(1, n), key=depth.__getitem__):
            if above[node]:
                self.fails[node] = self.onward(self.fails[above[node]], of[node])
            u, rest = self.ends[node], self.found[self.fails[node]]
            self.found[node] = rest if u < 0 or self.sizes[u] < 2 else ((self.sizes[u], u), *rest)

    def onward(self, node: int, code: int) -> int:
        """Where the symbol leads from a node: down the trie from it or from the first of its failure links that has it."""
        trie = self.trie
        while (to := trie.get(node << 20 | code)) is None and node:
            node = self.fails[node]
        return to or 0

    #: Most transitions between symbols that are kept.
    MOST = 150_000

    def reset(self) -> None:
        """No transition is kept."""
        for place in (self.root, *self.moves.values()):
            place.clear()
        self.moves.clear()
        self.kept = 0

    def step(self, at: Place, code: int) -> Place:
        """A transition that the table does not have."""
        if self.kept >= self.MOST:
            self.reset()
        node = self.onward(at.node, code)
        to = self.moves.get(node) if node else self.root
        if to is None:
            to = self.moves[node] = Place(self, node)
        at[code] = to
        self.kept += 1
        return to

    def tokens_of(self, codes: list[int]) -> list[int]:
        """The tokens, by number, of a word given by its symbols' codes: one step of the table for each, then the tokens from the end."""
        at, i, states, alone, ended, before = self.root, 0, self.states, self.alone, [], [self.start]
        for c in codes:
            at = at[c]
            i += 1
            for size, u in at.found:
                if before[i - size][u]:
                    break
            else:  # exactly one token ends here, so it is the symbol
                u = alone[c]
            ended.append(u)
            state = states.get(u)
            before.append(self.state(u) if state is None else state)
        out, sizes = [], self.sizes
        while i:
            u = ended[i - 1]
            out.append(u)
            i -= sizes[u]
        out.reverse()
        return out

    def encode(self, symbols: list[str]) -> list[str]:
        """The tokens of a word given by its base symbols."""
        for s in symbols:
            if s not in self.symbols:
                self.add(s, [s])
        return [self.tokens[u] for u in self.tokens_of([self.symbols[s] for s in symbols])]

    def numbers_of(self, piece: str) -> list[int]:
        """The tokens of a word's bytes, by number."""
        data = piece.encode("utf-8", "surrogatepass")
        codes = list(map(self.within.__getitem__, data))
        if codes:
            codes[-1] = self.at_end[data[-1]]
        return self.tokens_of(codes)

    def encode_bytes(self, piece: str) -> list[str]:
        return [self.tokens[u] for u in self.numbers_of(piece)]


def added_tokens(spec: dict) -> tuple[dict[str, int], regex.Pattern | None, str]:
    """A file's special strings with their ids, a pattern that finds them in raw text, and what all of them begin with."""
    found = {t["content"]: t["id"] for t in spec["added_tokens"]}
    if any(t.get(k) for t in spec["added_tokens"] for k in ("single_word", "lstrip", "rstrip", "normalized")):
        raise ValueError("special strings that depend on what is around them are not handled")
    at = regex.compile("|".join(map(regex.escape, sorted(found, key=len, reverse=True)))) if found else None
    return found, at, os.path.commonprefix(list(found))


def checked_model(spec: dict, suffix: str = "") -> dict:
    """The file's model, if it is byte-level and can spell every byte."""
    model = spec["model"]
    if any(model.get(k) for k in ("dropout", "unk_token", "continuing_subword_prefix", "byte_fallback", "ignore_merges")):
        raise ValueError("a kind of merges that is not handled")
    if missing := [c for c in byte_labels() if c not in model["vocab"] or c + suffix not in model["vocab"]]:
        raise ValueError(f"the vocabulary lacks bytes: {missing[:5]}")
    return model


class Known(dict):
    """Values by key, the most recent 1 or 2 times MOST of them: when full, it becomes the older generation, which what is asked for leaves again."""

    MOST = 50_000
    #: Longer keys are computed each time.
    LONGEST = 128

    def __init__(self, make) -> None:
        super().__init__()
        self.make, self.older = make, {}

    def __missing__(self, key: str):
        value = self.older.get(key)
        if value is None:
            value = self.make(key)
        if len(key) <= self.LONGEST:
            if len(self) >= self.MOST:
                self.older = dict(self)
                self.clear()
            self[key] = value
        return value


class WordTokenizer:
    """A tokenizer file with word ends: NFC, white space collapsed, lower case, pre-split words, byte-level merges."""

    def __init__(self, data: bytes, odd: str | None = None) -> None:
        spec = json.loads(data)
        model = checked_model(spec, spec["model"].get("end_of_word_suffix") or "")
        if [n["type"] for n in spec["normalizer"]["normalizers"]] != ["NFC", "Replace", "Lowercase"]:
            raise ValueError("a kind of normalisation that is not handled")
        ids = model["vocab"]
        self.automaton = Automaton([tuple(m) if not isinstance(m, str) else tuple(m.split(" ")) for m in model["merges"]], model.get("end_of_word_suffix") or "")
        self.special, self.special_at, self.begins = added_tokens(spec)
        split = next(p for p in spec["pre_tokenizer"]["pretokenizers"] if p["type"] == "Split")
        self.pieces = regex.compile(split["pattern"]["Regex"].replace(r"\s", SPACES))
        self.library = Library(odd, split["pattern"]["Regex"])
        self.packed = [np.array([ids[t]], "<u4").tobytes() if t in ids else None for t in self.automaton.tokens]
        self.chunks, self.words = Known(self.encode_chunk), Known(self.encode_piece)

    def lower(self, text: str) -> str:
        """Each character for itself: a sigma at the end of a word is no other letter than elsewhere."""
        if text.isascii():
            return text.lower()
        text = unicodedata.normalize("NFC", text)
        return text.lower() if "Σ" not in text else text.replace("Σ", "σ").lower()

    def encode_piece(self, piece: str) -> bytes:
        return b"".join(map(self.packed.__getitem__, self.automaton.numbers_of(piece)))

    def split(self, chunk: str) -> list[str]:
        """The words of what lies between white space, normalised."""
        if self.library.odd(chunk):
            return self.library.pieces(self.library.normal.normalize_str(chunk))
        low = self.lower(chunk)
        if low.isalpha():
            return [low]
        if low[:-1].isalpha() and low[-1] in ".,;:!?":
            return [low[:-1], low[-1]]
        return self.pieces.findall(low)

    def encode_chunk(self, chunk: str) -> bytes:
        words = self.split(chunk)
        if len(words) == 1 and words[0] == chunk:  # kept once, as a chunk
            return self.encode_piece(chunk)
        return b"".join([self.words[p] for p in words])

    def encode_plain(self, text: str) -> bytes:
        chunks = text.split() if ODD.search(text) is None else CHUNK.findall(text)
        return b"".join(map(self.chunks.__getitem__, chunks))

    def encode(self, text: str) -> bytes:
        """Ids as little-endian unsigned 32-bit integers."""
        if self.special_at is None or self.begins not in text:
            return self.encode_plain(text)
        out, at = [], 0
        for m in self.special_at.finditer(text):
            out += [self.encode_plain(text[at : m.start()]), np.array([self.special[m[0]]], "<u4").tobytes()]
            at = m.end()
        return b"".join([*out, self.encode_plain(text[at:])])


class TokenLabels:
    """The labels of a tokenizer file's arcs, by id."""

    def __init__(self, data: bytes, odd: str | None = None) -> None:
        spec = json.loads(data)
        ids = spec["model"]["vocab"] | {t["content"]: t["id"] for t in spec["added_tokens"]}
        self.label = [""] * (max(ids.values()) + 1)
        for t, i in ids.items():
            self.label[i] = t

    def decode(self, ids: bytes) -> str:
        """The arc labels with a space between them, as files without a decoder have it."""
        return " ".join(map(self.label.__getitem__, np.frombuffer(ids, "<u4").tolist()))


LOADED: dict[tuple, object] = {}


def loaded(make, data):
    """One tokenizer for each worker process and file."""
    content, odd = data.value
    key = (make, len(content), hash(content))
    if key not in LOADED:
        LOADED[key] = make(content, odd)
    return LOADED[key]


def unload() -> None:
    """Drops the tokenizers that earlier tasks have left in this worker process (some 200 MB with their tables). Later tasks load them again.

    Spark hands a worker on from stage to stage, so operators that need memory of their own call this as their tasks begin.
    """
    if LOADED:
        LOADED.clear()
        gc.collect()


def tokenizer_data(spark, path: str):
    """The file's bytes (one or two MB, whatever the input) and the odd characters, for all executors."""
    with open(path, "rb") as f:
        return spark.sparkContext.broadcast((f.read(), odd_characters()))


def slices(batch: pa.RecordBatch, column: str, most: int = 4 << 20):
    """Parts of a batch with up to so many bytes of a text column, or one row."""
    sizes = np.asarray(pc.binary_length(batch[column]).fill_null(0)).astype(np.int64)
    at = 0
    while at < batch.num_rows:
        total, end = 0, at
        while end < batch.num_rows and (end == at or total + sizes[end] <= most):
            total += int(sizes[end])
            end += 1
        yield batch.slice(at, end - at)
        at = end


def map_column(df: DataFrame, column: str, names: list[tuple[str, str, pa.DataType]], make, keep: bool = True) -> DataFrame:
    """Appends columns computed from one column, which goes unless keep is set; columns of the new names are replaced.

    make() returns, in the worker, a function from a list of values to lists, one for each new column.
    """
    from pyspark.sql import types as T

    df = df.drop(*(n for n, _, _ in names if n != column))
    stay = [i for i, f in enumerate(df.schema.fields) if keep or f.name != column]
    schema = T.StructType([*(df.schema.fields[i] for i in stay), *(T.StructField(n, T._parse_datatype_string(t)) for n, t, _ in names)])
    kinds = [k for _, _, k in names]
    labels = schema.names

    def run(batches):
        f = make()
        for whole in batches:
            for part in slices(whole, column, 1 << 20):
                new = f(part[column].to_pylist())
                yield pa.RecordBatch.from_arrays([*(part.columns[i] for i in stay), *(pa.array(v, k) for v, k in zip(new, kinds, strict=True))], names=labels)

    return df.mapInArrow(lean(run), schema)


def encode_column(df: DataFrame, data, text: str = "text", ids: str = "token_ids", keep: bool = True) -> DataFrame:
    """Appends the ids of each text, packed as little-endian unsigned 32-bit integers. A null text counts as empty. data: tokenizer_data()."""

    def make():
        t = loaded(WordTokenizer, data)
        return lambda texts: [[t.encode(x or "") for x in texts]]

    return map_column(df, text, [(ids, "binary", pa.binary())], make, keep)


def decode_column(df: DataFrame, data, ids: str = "token_ids", text: str = "decoded", keep: bool = True) -> DataFrame:
    """Appends the text that packed ids decode to; null for null."""

    def make():
        t = loaded(TokenLabels, data)
        return lambda packed: [[None if x is None else t.decode(x) for x in packed]]

    return map_column(df, ids, [(text, "string", pa.string())], make, keep)


class TokenCounter:
    """Counts the tokens of a byte-level tokenizer file.

    The whole-token shortcut: every string of the vocabulary is merged by itself
    when the file is read, and those that end as one token make up ``alone``. A
    pre-token among them counts as one without any merging; only the rest are merged.
    """

    def __init__(self, data: bytes, odd: str | None = None) -> None:
        spec = json.loads(data)
        model = checked_model(spec)
        before = spec["pre_tokenizer"]
        if before["type"] != "ByteLevel" or not before["use_regex"] or before["add_prefix_space"] or spec["normalizer"]:
            raise ValueError("a kind of pre-tokens that is not handled")
        merges = [tuple(m) if not isinstance(m, str) else tuple(m.split(" ")) for m in model["merges"]]
        self.ranks = {m: i for i, m in enumerate(merges)}
        self.labels = byte_labels()
        self.special, self.special_at, self.begins = added_tokens(spec)
        # Fixed value: the library's own pattern for files that say use_regex; such files do not hold it.
        split = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
        self.pieces = regex.compile(split.replace(r"[^\s", "[^" + SPACES).replace(r"\s", f"[{SPACES}]").replace(r"\S", f"[^{SPACES}]"))
        self.library = Library(odd)
        byte = {c: b for b, c in enumerate(self.labels)}
        self.byte_of = byte
        self.alone = {bytes(byte[c] for c in t) for t in model["vocab"] if all(c in byte for c in t) and self.merged(list(t)) == 1}
        self.chunks, self.words = Known(self.count_pieces), Known(self.count_piece)

    def merged(self, symbols: list[str]) -> int:
        """How many tokens the merges leave of these symbols: the best-ranked pair first, from the left."""
        ranks = self.ranks
        n = len(symbols)
        if n < 40:
            none = 1 << 60
            pairs = [ranks.get(p, none) for p in zip(symbols, symbols[1:])]
            while pairs and (best := min(pairs)) != none:
                i = pairs.index(best)
                symbols[i : i + 2] = [symbols[i] + symbols[i + 1]]
                del pairs[i]
                if i:
                    pairs[i - 1] = ranks.get((symbols[i - 1], symbols[i]), none)
                if i < len(pairs):
                    pairs[i] = ranks.get((symbols[i], symbols[i + 1]), none)
            return len(symbols)
        after, before = [*range(1, n), -1], [-1, *range(n - 1)]
        heap = [(ranks[p], i, p) for i, p in enumerate(zip(symbols, symbols[1:])) if p in ranks]
        heapq.heapify(heap)
        while heap:
            _, i, pair = heapq.heappop(heap)
            j = after[i]
            if j < 0 or symbols[i] is None or (symbols[i], symbols[j]) != pair:
                continue
            symbols[i], symbols[j] = symbols[i] + symbols[j], None
            after[i] = after[j]
            if after[j] >= 0:
                before[after[j]] = i
            n -= 1
            for k in (before[i], i):
                if k >= 0 and after[k] >= 0 and (p := (symbols[k], symbols[after[k]])) in ranks:
                    heapq.heappush(heap, (ranks[p], k, p))
        return n

    def count_piece(self, piece: str) -> int:
        data = piece.encode("utf-8", "surrogatepass")
        return 1 if data in self.alone else self.merged([self.labels[b] for b in data])

    def split(self, text: str) -> list[str]:
        """The pre-tokens of a text."""
        if self.library.odd(text):
            return [bytes(map(self.byte_of.__getitem__, p)).decode("utf-8") for p in self.library.pieces(text)]
        bare = text[1:] if text[:1] == " " else text
        if bare.isalpha():
            return [text]
        if bare[:-1].isalpha() and bare[-1] in ".,;:!?":
            return [text[:-1], text[-1]]
        return self.pieces.findall(text)

    def count_pieces(self, text: str) -> int:
        return sum([self.words[p] for p in self.split(text)])

    def count_plain(self, text: str) -> int:
        """A space between two characters that aren't white space begins a pre-token; runs of white space are split with what is around them."""
        if not text:
            return 0
        first, *rest = text.split(" ") if RUN.search(text) is None else LONE.split(text)
        known = self.chunks
        return (known[first] if first else 0) + sum([known[c] for c in map(" ".__add__, rest)])

    def count(self, text: str) -> int:
        if self.special_at is None or self.begins not in text:
            return self.count_plain(text)
        parts = self.special_at.split(text)
        return len(parts) - 1 + sum(map(self.count_plain, parts))


def round_trip_column(df: DataFrame, data, text: str = "text", ids: str = "token_ids", decoded: str = "decoded", keep: bool = True) -> DataFrame:
    """encode_column and decode_column of its ids, in one Python process for each task."""

    def make():
        t, labels = loaded(WordTokenizer, data), loaded(TokenLabels, data)

        def run(texts):
            packed = [t.encode(x or "") for x in texts]
            return [packed, [labels.decode(x) for x in packed]]

        return run

    return map_column(df, text, [(ids, "binary", pa.binary()), (decoded, "string", pa.string())], make, keep)


def count_column(df: DataFrame, data, text: str = "text", count: str = "n_tokens", keep: bool = True) -> DataFrame:
    """Appends the number of tokens of each text, special strings inside of it as one. A null text counts as empty. data: tokenizer_data()."""

    def make():
        t = loaded(TokenCounter, data)
        return lambda texts: [[t.count(x or "") for x in texts]]

    return map_column(df, text, [(count, "long", pa.int64())], make, keep)
