"""Token counts by a finite-state tokenizer compiled from a byte-pair vocabulary.

The merges of a word become a deterministic transducer over its symbols. A state holds the longest suffix read that
begins some token and, for each position inside that suffix, the last token of the encoding up to there and how many
tokens came after it; that is all that later symbols can depend on, because a sequence of tokens is the encoding of
its string if every adjacent pair is. A transition carries the number of tokens it emits (which may be negative: a
later merge takes tokens back). States and transitions are determinised when first reached and kept.

Every text is cut into chunks of about `chunk` characters, and each chunk becomes a state map: for every state that it may be
entered in, the exit state and the tokens emitted in between. A cut is made where a piece surely ends (white space, an ASCII
digit) if there is such a place within REACH characters; there the state between words is the only one. Else it is made in a
run of plain letters, where the letters before the cut leave a few states possible (see `Transducer.entries`): one for most
words, several for words that repeat themselves. All of them are mapped. Where more than MOST_ENTRIES are possible, or the run
is too short to tell, the chunk runs on to the next place. Maps of neighbours then compose pairwise, the right one being looked
up by the exit states of the left one, in as many rounds as the largest number of chunks has binary digits. A map is of bounded
size, whatever the text. First chunks are mapped by the task that reads the text, all others are dealt to all tasks, so a very
long text is the work of many.

Null and empty texts count 0 tokens and 0 bytes. Rows are counted one by one, so null or repeated ids, ties and repeated
rows stay; an empty table gives an empty result; extra columns are ignored, whatever their names.
"""

from __future__ import annotations

import json
from collections.abc import Iterator, Sequence

import pyarrow as pa
import public_tokenizers
import regex
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pixelseries.llm.common import stored

DEFAULT = public_tokenizers.path("word_bpe_49k.json")
CHUNK = 1 << 14
REACH = 1 << 10
MOST_ENTRIES = 16
MOST_WAYS = 1 << 9
CACHED_WORDS = 1 << 20
MOST_STATES = 1 << 18


def byte_symbols() -> list[str]:
    """The printable character that stands for each byte: itself if printable, else the next free one from 256."""
    own = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    free = iter(range(256, 512))
    return [chr(b) if b in own else chr(next(free)) for b in range(256)]


GONE = ("", 0)


class Transducer:
    """Counts the tokens of one word, a sequence of symbols of which the last carries the end mark."""

    def __init__(self, vocab: dict[str, int], merges: list[tuple[str, str]], end: str) -> None:
        self.pair_rank = {m: k for k, m in enumerate(merges)}
        self.rank = {a + b: k for k, (a, b) in enumerate(merges)}
        self.parts = {a + b: (a, b) for a, b in merges}
        self.owns: dict[str, bool] = {}
        self.end = end
        self.vocab = vocab
        self.begins = {self.plain(t)[:k] for t in vocab for k in range(1, len(self.plain(t)))}
        self.longest = max(len(self.plain(t)) for t in vocab)
        self.lead = 4 * self.longest  # symbols that `entries` asks for
        self.pairs: dict[tuple[str | None, str], bool] = {}
        self.forget()

    def forget(self) -> None:
        """Drops all states but the first."""
        #: a state's window: for k = 0.. the last token of the encoding that ends k symbols back, and the tokens since
        self.windows: list[tuple[str, tuple[tuple[str | None, int], ...]]] = [("", ((None, 0),))]
        self.ids = {self.windows[0]: 0}
        self.steps: list[dict[str, tuple[int, int]]] = [{}]
        self.ends: list[dict[str, int]] = [{}]

    def plain(self, token: str) -> str:
        """The token with one character for each symbol: a final symbol's mark is left off."""
        return token.removesuffix(self.end) if len(token) > len(self.end) else token

    def seam_holds(self, left: str, right: str) -> bool:
        """Whether two tokens, each its own encoding, stay apart side by side: no pair of parts that meet at the seam
        at some moment of the merging is merged. The parts are undone from the latest merge backwards."""
        rank, parts = self.rank, self.parts
        a, b = rank.get(left, -1), rank.get(right, -1)
        until = 1 << 60  # merges from this rank on come too late for the parts in hand
        while True:
            if self.pair_rank.get((left, right), until) < until:
                return False
            if a < 0 and b < 0:
                return True
            if a > b:
                until, left = a, parts[left][1]
                a = rank.get(left, -1)
            else:  # at one rank the leftmost pair merges first
                until, right = b + 1, parts[right][0]
                b = rank.get(right, -1)

    def own(self, token: str) -> bool:
        """Whether a token is the encoding of its own string: its two parts are, and stay apart until their merge."""
        known = self.owns.get(token)
        if known is None:
            if token not in self.parts:
                known = True
            else:
                left, right = self.parts[token]
                known = self.own(left) and self.own(right) and self.apart_before(left, right, self.rank[token])
            self.owns[token] = known
        return known

    def apart_before(self, left: str, right: str, rank: int) -> bool:
        held = self.pair_rank.pop((left, right))
        try:
            return self.seam_holds(left, right)
        finally:
            self.pair_rank[left, right] = held

    def follows(self, before: str | None, token: str) -> bool:
        """Whether an encoding may hold `before` and then `token`; before None: whether it may begin with token."""
        known = self.pairs.get((before, token))
        if known is None:
            known = self.own(token) and (before is None or self.seam_holds(before, token))
            self.pairs[before, token] = known
        return known

    def last(self, state: int, symbol: str) -> tuple[str, int, int]:
        """The last token after one more symbol, where it begins (symbols back) and the tokens emitted."""
        read, window = self.windows[state]
        for k in range(len(window) - 1, -1, -1):
            token = read[len(read) - k :] + symbol
            before, since = window[k]
            if token in self.vocab and before != "" and self.follows(before, token):
                return token, k, 1 - since
        raise ValueError(f"no encoding after {read!r} for {symbol!r}")

    def compile_step(self, state: int, c: str) -> tuple[int, int]:
        token, _, emitted = self.last(state, c)
        read, window = self.windows[state]
        full, longer = read + c, ((token, 0), *((t, n + emitted) for t, n in window))
        keep = next((k for k in range(len(full), 0, -1) if full[-k:] in self.begins), 0)
        full = full[len(full) - keep :]
        # places inside the suffix at which no token can begin any more are forgotten
        key = (full, tuple(x if not k or full[keep - k :] in self.begins else GONE for k, x in enumerate(longer[: keep + 1])))
        nxt = self.ids.setdefault(key, len(self.windows))
        if nxt == len(self.windows):
            self.windows.append(key)
            self.steps.append({})
            self.ends.append({})
        self.steps[state][c] = nxt, emitted
        return nxt, emitted

    def run(self, state: int, symbols: str) -> tuple[int, int]:
        """The state behind more symbols of an open word, and the tokens emitted."""
        n, steps = 0, self.steps
        for c in symbols:
            step = steps[state].get(c)
            state, emitted = step if step is not None else self.compile_step(state, c)
            n += emitted
        return state, n

    def finish(self, state: int, symbols: str) -> int:
        """The tokens emitted by the rest of an open word, one symbol at least."""
        state, n = self.run(state, symbols[:-1])
        c = symbols[-1]
        done = self.ends[state].get(c)
        if done is None:
            done = self.ends[state][c] = self.last(state, c + self.end)[2]
        return n + done

    def last_tokens(self, symbols: str) -> list[set[str]]:
        """For each number of symbols read, the tokens that the encoding up to there may end with, whatever came before
        the symbols. Some token begins among the first symbols, as none is longer than `longest`, and from its
        beginning on the encoding is that of the symbols from there alone."""
        found: list[set[str]] = [set() for _ in range(len(symbols) + 1)]
        for begin in range(self.longest):
            state = 0
            for k in range(begin, len(symbols)):
                state, _ = self.steps[state].get(symbols[k]) or self.compile_step(state, symbols[k])
                found[k + 1].add(self.windows[state][1][0][0])
        return found

    def entries(self, symbols: str) -> list[str] | None:
        """Names of all states that an open word may be in behind `lead` symbols of it or more, whatever came before them; null
        if they are too many or differ in counts that the symbols do not tell.

        The last tokens are chosen from left to right, in every way that agrees with the pairs of tokens that may follow
        each other. As an encoding is unique, a token that may follow the one before it is the only choice."""
        n, since = len(symbols), 2 * self.longest
        if n < self.lead:
            return None
        may = self.last_tokens(symbols)
        ways: list[tuple[str, ...]] = [()]  # of tokens that end at since + 1, since + 2, ...
        for end in range(since + 1, n + 1):
            longer = []
            for way in ways:
                sure, open_ = [], []
                for token in sorted(may[end]):
                    begin = end - len(token)
                    if begin <= since:
                        open_.append(token)
                    elif self.follows(way[begin - since - 1], token):
                        sure.append(token)
                longer += [(*way, token) for token in sure or open_]
            ways = longer
            if len(ways) > MOST_WAYS:
                return None
        full = next(symbols[n - k :] for k in range(min(n, self.longest), -1, -1) if not k or symbols[n - k :] in self.begins)
        names: set[str] = set()
        for way in ways:
            roots: list[tuple[int, int]] = []  # of each end: where its tokens' chain leaves the known part, tokens since
            for k, token in enumerate(way):
                begin = k - len(token)
                root, count = (begin, 0) if begin < 0 else roots[begin]
                roots.append((root, count + 1))
            window: list[tuple[str | None, int]] = []
            for k in range(len(full) + 1):
                if k and full[len(full) - k :] not in self.begins:
                    window.append(GONE)
                    continue
                if roots[-1 - k][0] != roots[-1][0]:
                    return None
                window.append((way[-1 - k], roots[-1][1] - roots[-1 - k][1]))
            names.add(self.name(self.state(json.dumps((full, window)))))
        return sorted(names) if len(names) <= MOST_ENTRIES else None

    def count(self, word: str) -> int:
        if len(self.windows) > MOST_STATES:  # only memory is at stake: states come back when next reached
            self.forget()
        return self.finish(0, word)

    def name(self, state: int) -> str:
        """The state as text that any process understands."""
        return json.dumps(self.windows[state])

    def state(self, name: str) -> int:
        read, window = json.loads(name)
        key = (read, tuple((t, n) for t, n in window))
        found = self.ids.setdefault(key, len(self.windows))
        if found == len(self.windows):
            self.windows.append(key)
            self.steps.append({})
            self.ends.append({})
        return found


PLAIN = 32  # letters before a cut inside a word, more than the name of any special token has
#: Places where a piece surely ends and, failing those, places between two of many plain letters, from the right.
BORDER = regex.compile("(?r)(?=[\x20\x09-\x0d])|(?<=[A-Za-z0-9])(?=[0-9])|(?<=[0-9])(?=[A-Za-z])|(?<=[\u4e00-\u9fa5])(?=[\u3002\uff0c])")
INSIDE = regex.compile("(?r)(?<=[A-Za-z]{%d})(?=[A-Za-z])|(?<=[\u4e00-\u9fa5]{%d})(?=[\u4e00-\u9fa5])" % (PLAIN, PLAIN))
LETTERS = regex.compile("(?:[A-Za-z]+|[\u4e00-\u9fa5]+)\\Z")


class Counter:
    """Token counts of texts for a word-end BPE file of the tokenizers library."""

    def __init__(self, path: str) -> None:
        from tokenizers import Tokenizer

        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        model = spec["model"]
        merges = [tuple(m) if isinstance(m, list) else tuple(m.split(" ")) for m in model["merges"]]
        end = model["end_of_word_suffix"]
        if model["type"] != "BPE" or not end:
            raise ValueError(f"{path}: a BPE model with word ends is needed")
        self.machine = Transducer(model["vocab"], merges, end)
        self.symbol = byte_symbols()
        if missing := [s for b in self.symbol for s in (b, b + end) if s not in model["vocab"]]:
            raise ValueError(f"{path}: symbols without a token: {missing[:3]}")
        pattern = next(p["pattern"]["Regex"] for p in spec["pre_tokenizer"]["pretokenizers"] if p["type"] == "Split")
        self.split = regex.compile(pattern.replace(r"\s", r"\p{White_Space}"))
        self.special = regex.compile("|".join(regex.escape(t["content"]) for t in spec["added_tokens"]))
        library = Tokenizer.from_file(path)
        self.normalizer, self.pre_tokenizer = library.normalizer, library.pre_tokenizer
        self.words: dict[bytes, int] = {}

    def pieces(self, text: str) -> list[str]:
        """The pieces that merges never cross, as symbols."""
        if text.isascii():
            words = self.split.findall(text.lower())
        else:
            text = self.normalizer.normalize_str(text)
            # beyond the common Latin letters the tables of Unicode versions differ, so the library itself splits
            if max(text, default="") > "\u024f":
                return [w for w, _ in self.pre_tokenizer.pre_tokenize_str(text)]
            words = self.split.findall(text)
        symbol = self.symbol
        return [w if w.isascii() and w.isprintable() else "".join([symbol[b] for b in w.encode()]) for w in words]

    def parts(self, text: str) -> list[str | None]:
        """The pieces of a text, null for a special token."""
        if "<|" not in text:
            return self.pieces(text)
        out, at = [], 0
        for m in self.special.finditer(text):
            out += [*self.pieces(text[at : m.start()]), None]
            at = m.end()
        return out + self.pieces(text[at:])

    def word(self, word: str) -> int:
        count = self.machine.count
        return sum(1 if p is None else count(p) for p in self.parts(word))

    def count(self, text: bytes) -> int:
        """Tokens of UTF-8 text. bytes.split() cuts at ASCII white space only."""
        if len(self.words) > CACHED_WORDS:
            self.words.clear()
        known, n = self.words, 0
        for w in text.split():
            k = known.get(w)
            if k is None:
                k = self.word(w.decode())
                if len(w) < 64:
                    known[w] = k
            n += k
        return n

    def cuts(self, text: str, size: int, reach: int = REACH) -> list[tuple[int, list[str] | None]]:
        """Where chunks begin, near every multiple of size, and the states that they may be entered in: null for the one
        between words."""
        lead = self.machine.lead
        out: list[tuple[int, list[str] | None]] = [(0, None)]
        for at in range(size, len(text), size):
            low = max(out[-1][0] + 1, at - reach)
            if low > at:
                continue
            base = max(0, low - PLAIN)
            near = text[base : at + 1]
            if m := BORDER.search(near, low - base):
                out.append((base + m.start(), None))
            elif m := INSIDE.search(near, low - base):
                place = base + m.start()
                entries = self.entries(LETTERS.search(text[max(0, place - lead) : place]).group())
                if entries is not None:
                    out.append((place, entries))
        return out

    def entries(self, letters: str) -> list[str] | None:
        """The states that a word may be in behind these letters of it."""
        if len(self.machine.windows) > MOST_STATES:
            self.machine.forget()
        return self.machine.entries("".join(self.pieces(letters))[-2 * self.machine.lead :])

    def walk(self, parts: list[str | None], entry: str | None, goes_on: bool) -> tuple[int, str | None]:
        machine, n = self.machine, 0
        for k, p in enumerate(parts):
            state = machine.state(entry) if k == 0 and entry is not None else 0
            if goes_on and k == len(parts) - 1:
                state, more = machine.run(state, p)
                return n + more, machine.name(state)
            n += 1 if p is None else machine.finish(state, p)
        return n, None

    def map(self, text: str, entry: str | None, goes_on: bool) -> tuple[int, str | None]:
        """Tokens emitted and exit state of a chunk; a null state is the one between words. goes_on: whether the last
        word is open at the chunk's end."""
        if len(self.machine.windows) > MOST_STATES:
            self.machine.forget()
        spaces = [m.start() for m in (regex.search(r"[\x20\x09-\x0D]", text), regex.search(r"(?r)[\x20\x09-\x0D]", text)) if m]
        if not spaces:
            return self.walk(self.parts(text), entry, goes_on)
        n = self.walk(self.parts(text[: spaces[0]]), entry, False)[0] + self.count(text[spaces[0] : spaces[1]].encode())
        last, state = self.walk(self.parts(text[spaces[1] + 1 :]), None, goes_on)
        return n + last, state


_COUNTERS: dict[str, Counter] = {}


def counter(path: str) -> Counter:
    """One for each worker process, kept between tasks."""
    if path not in _COUNTERS:
        _COUNTERS[path] = Counter(path)
    return _COUNTERS[path]


MAPS = "array<struct<entry: string, exit: string, n: long>>"
CHUNKS = f"row long, doc_id long, k int, chunks int, n_bytes long, maps {MAPS}, goes_on boolean, entries array<string>, text string"
NAMES = ["row", "doc_id", "k", "chunks", "n_bytes", "maps", "goes_on", "entries", "text"]
KINDS = [
    pa.int64(), pa.int64(), pa.int32(), pa.int32(), pa.int64(), pa.list_(pa.struct([("entry", pa.string()), ("exit", pa.string()), ("n", pa.int64())])),
    pa.bool_(), pa.list_(pa.string()), pa.string(),
]
BETWEEN = ""  # name of the state between words, in columns


def _table(columns: Sequence[pa.Array | list]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([c if isinstance(c, pa.Array) else pa.array(c, kind) for c, kind in zip(columns, KINDS)], NAMES)


def state_map(c: Counter, text: str, entries: list[str], goes_on: bool) -> list[tuple[str, str, int]]:
    """(entry, exit, tokens emitted) of a chunk for each state that it may be entered in."""
    out = []
    for entry in entries:
        n, state = c.map(text, entry or None, goes_on)
        out.append((entry, state or BETWEEN, n))
    return out


def chunks(docs: DataFrame, path: str, chunk: int) -> DataFrame:
    """A row for each chunk of each text: the state map of first chunks, and the others with their text, still to be mapped."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        c = counter(path)
        for b in batches:
            size = [len(t.as_buffer()) for t in b.column(2)]
            texts, maps, counts, goes_on, rest = b.column(2).cast(pa.large_binary()), [], [], [], []
            for t, bytes_, row, doc_id in zip(texts, size, b.column(0), b.column(1)):
                cuts = c.cuts(t.as_py().decode(), chunk) if bytes_ > chunk else [(0, None)]
                counts.append(len(cuts))
                if len(cuts) == 1:
                    maps.append([(BETWEEN, BETWEEN, c.count(t.as_py()))])
                    goes_on.append(False)
                    continue
                text, ends = t.as_py().decode(), [*cuts[1:], (None, None)]
                own = text[: ends[0][0]]
                goes_on.append(ends[0][1] is not None)
                maps.append(state_map(c, own, [BETWEEN], goes_on[-1]))
                size[len(maps) - 1] = len(own.encode())
                for k, ((at, entries), (end, next_)) in enumerate(zip(cuts[1:], ends[1:]), 1):
                    rest.append((row.as_py(), doc_id.as_py(), k, len(cuts), len(text[at:end].encode()), None, next_ is not None, entries or [BETWEEN], text[at:end]))
            none = [None] * len(maps)
            yield _table([b.column(0), b.column(1), [0] * len(maps), counts, size, maps, goes_on, none, none])
            for at in range(0, len(rest), 256):  # batches of bounded size
                yield _table(list(zip(*rest[at : at + 256])))

    rows = docs.select(F.monotonically_increasing_id().alias("row"), F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text"))
    return stored(rows.mapInArrow(run, CHUNKS), "chunks")


def mapped(rows: DataFrame, path: str) -> DataFrame:
    """State maps of chunks that came with their text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        c = counter(path)
        for b in batches:
            maps = [state_map(c, text, entries, on) for on, entries, text in zip(*(b.column(k).to_pylist() for k in (6, 7, 8)))]
            none = [None] * len(maps)
            yield _table([*b.columns[:5], maps, b.column(6), none, none])

    return rows.select(NAMES).mapInArrow(run, CHUNKS)


def composed(left: Column, right: Column) -> Column:
    """The map of a chunk and the next one: the right map is looked up by the exit states of the left one."""

    def through(m: Column) -> Column:
        then = F.filter(right, lambda r: r["entry"] == m["exit"])
        met = F.when(F.size(then) == 1, then[0]).otherwise(F.raise_error(F.lit("a chunk is entered in a state that it has no map for")).cast("struct<entry: string, exit: string, n: long>"))
        return F.struct(m["entry"].alias("entry"), met["exit"].alias("exit"), (m["n"] + met["n"]).alias("n"))

    return F.transform(left, through)


def scanned(maps: DataFrame, longest: int) -> DataFrame:
    """(row, doc_id, chunks, n_bytes, maps) of whole texts from those of their chunks, k = 0, 1, ..., `longest` at most."""
    out = maps.select("row", "doc_id", "k", "chunks", "n_bytes", "maps")
    for _ in range((longest - 1).bit_length()):
        pair = out.groupBy("row", F.floor(F.col("k") / 2).cast("int").alias("half")).agg(
            F.min("doc_id").alias("doc_id"), F.max("chunks").alias("chunks"), F.sum("n_bytes").alias("n_bytes"),
            F.count("*").alias("n"), F.min_by("maps", "k").alias("left"), F.max_by("maps", "k").alias("right"),
        )
        both = F.when(F.col("n") == 1, F.col("left")).otherwise(composed(F.col("left"), F.col("right")))
        out = pair.select("row", "doc_id", F.col("half").alias("k"), "chunks", "n_bytes", both.alias("maps"))
    return out


def token_counts(docs: DataFrame, path: str = DEFAULT, limit: int = 2048, chunk: int = CHUNK) -> DataFrame:
    """doc_id, n_bytes, n_tokens, over_limit (more than `limit` tokens), n_chunks."""
    cut = chunks(docs, path, chunk)
    later = mapped(cut.where("text is not null").repartition("row", "k"), path)
    longest = cut.agg(F.max("chunks")).first()[0] or 1
    whole = cut.where("chunks = 1")
    if longest > 1:
        whole = whole.unionByName(scanned(cut.where("text is null and chunks > 1").unionByName(later), longest), allowMissingColumns=True)
    n = F.col("maps")[0]["n"]
    return whole.select("doc_id", "n_bytes", n.alias("n_tokens"), (n > limit).alias("over_limit"), F.col("chunks").alias("n_chunks"))
