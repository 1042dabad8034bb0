"""BPE encoding by per-prefix dynamic programming (operator 11).

A sequence of tokens is the BPE encoding of its bytes exactly when every token
is reachable (the encoding of its own bytes) and every two neighbours are
compatible: no merge that crosses their border comes up before both are whole.
So each prefix of a pre-token has one possible last token.  A walk of all
places at once down a trie of the reachable tokens reports, place by place, every
token that is a suffix of the bytes read; the one that is compatible with the last token of the prefix
before it is stored, and the back-pointers from the end give the ids.

Texts are first cut at the strings of added tokens (or not at all, with
``added=False``) and into pre-tokens by the vocabulary's own rule.  A space
followed by a character that is no blank always begins a pre-token, so texts are
cut there first and the ids of such units are remembered, up to a bound.

The driver reads the vocabulary once and ships its tokens and merges (about the
size of the file); a Python worker opens them once for all its tasks.  Nothing
is shuffled.

Edge cases: a null text is the empty text (no tokens); texts of any length are
encoded whole; a vocabulary with other rules than byte-level BPE is refused;
repeated rows give equal results; an empty table gives an empty result; other
columns are ignored by the query and kept by ``encode`` and ``decode``.
"""

from __future__ import annotations

import hashlib
import json
import re
from itertools import chain

import numpy as np
import public_tokenizers
import pyarrow as pa
import regex
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.types import ArrayType, IntegerType, LongType, StringType, StructType
from tokenizers import pre_tokenizers

from rebound.llm.bpe import byte_characters
from rebound.llm.words import chunks, utf8

VOCABULARY = "byte_bpe_50k.json"
#: Units and pre-tokens that a worker remembers, each, from one run of texts to the next.
CACHE = 400_000
#: Token pairs whose test it remembers (a power of two).
PAIRS = 1 << 20
#: Longer pre-tokens are encoded one by one.
LONG = 64
#: Characters whose classes are not the same in every version of Unicode, and others past them.
LATER = re.compile(r"[^\0-\u024f]")
#: Stands between pre-tokens; no byte.
SEPARATOR = "\u0100"
#: A space before a character that is no blank: always the first of a pre-token.
UNIT = re.compile(r" (?=\S)")

_OPEN: dict = {}


class Vocabulary:
    """Tokens by id, the merges as (left, right, whole) by rank, and the added tokens."""

    def __init__(self, tokens: list[bytes], merges: list[tuple[int, int, int]], added: dict[str, int]):
        self.tokens, self.merges, self.added = tokens, merges, added
        self.key = hashlib.sha256(repr((tokens, merges, sorted(added.items()))).encode()).hexdigest()


def read_vocabulary(path: str) -> Vocabulary:
    """The vocabulary of a tokenizer file, which must hold plain byte-level BPE."""
    with open(path, encoding="utf-8") as f:
        spec = json.load(f)
    model, pre, dec = spec["model"], spec.get("pre_tokenizer") or {}, spec.get("decoder") or {}
    plain = (model.get("type") == "BPE" and spec.get("normalizer") is None and pre.get("type") == dec.get("type") == "ByteLevel"
             and pre.get("use_regex", True) and not pre.get("add_prefix_space")
             and not any(model.get(k) for k in ("dropout", "unk_token", "continuing_subword_prefix", "end_of_word_suffix", "fuse_unk", "byte_fallback", "ignore_merges"))
             and not any(a[k] for a in spec["added_tokens"] for k in ("single_word", "lstrip", "rstrip", "normalized")))
    if not plain:
        raise ValueError(f"{path}: not plain byte-level BPE")
    byte = {c: i for i, c in enumerate(byte_characters())}
    vocab, added = model["vocab"], {a["content"]: a["id"] for a in spec["added_tokens"]}
    tokens: list = [None] * (max([*vocab.values(), *added.values()]) + 1)
    for token, i in vocab.items():
        tokens[i] = bytes(byte[c] for c in token)
    for token, i in added.items():
        tokens[i] = token.encode()
    pairs = [tuple(m.split(" ")) if isinstance(m, str) else tuple(m) for m in model["merges"]]
    merges = [(vocab[a], vocab[b], vocab[a + b]) for a, b in pairs]
    made: dict = {}
    for rank, (a, b, t) in enumerate(merges):
        if t in made or any(len(tokens[p]) > 1 and p not in made for p in (a, b)):
            raise ValueError(f"{path}: merge {rank} makes a token again or from parts that come later")
        made[t] = rank
    if None in tokens or sum(len(t) == 1 for t in tokens) != 256:
        raise ValueError(f"{path}: ids with gaps, or not every byte is a token")
    return Vocabulary(tokens, merges, added)


class _Tables:
    """What a worker holds of a vocabulary, and the units it has seen.

    A unit is a piece of text that no pre-token crosses the ends of; its key is
    the piece without its first space, a tuple of the piece if it has none, or the
    id of an added token.
    """

    def __init__(self, v: Vocabulary):
        self.size = np.array([len(t) for t in v.tokens])
        whole = np.array(v.merges, np.int64).reshape(-1, 3)
        self.rank = np.full(len(v.tokens), -1)  # when a token is made; -1 for a byte
        self.left, self.right = np.arange(len(v.tokens)), np.arange(len(v.tokens))
        self.rank[whole[:, 2]] = np.arange(len(whole))
        self.left[whole[:, 2]], self.right[whole[:, 2]] = whole[:, 0], whole[:, 1]
        key = whole[:, 0] << 32 | whole[:, 1]
        self.merge_rank = np.argsort(key, kind="stable")
        self.merge_key = np.append(key[self.merge_rank], -1)
        self.seen_key, self.seen = np.full(PAIRS, -1), np.zeros(PAIRS, bool)

        kept = self._uncrossed(whole[:, 0], whole[:, 1], np.arange(len(whole))) if len(whole) else []
        reachable = self.size == 1
        for (a, b, t), ok in zip(v.merges, kept):
            reachable[t] = ok and reachable[a] and reachable[b]
        self.known = {}
        for t in np.flatnonzero(reachable).tolist():
            if t not in v.added.values():
                self.known[v.tokens[t].decode("latin-1")] = (t,)
        self._grow(self.known.items())
        self.words, self.units = {}, {}
        self.added = {i: (i,) for i in v.added.values()}
        self.short = regex.compile(public_tokenizers.PATTERN).findall
        self.library = pre_tokenizers.ByteLevel(add_prefix_space=False, use_regex=True).pre_tokenize_str

    def _grow(self, words):
        """A trie of the reachable tokens as flat arrays: steps by (node, character) in a table of open addresses, tokens by node."""
        step, ends = {}, {}
        for chars, (t,) in words:
            node = 0
            for c in chars:
                node = step.setdefault(node << 8 | ord(c), len(step) + 1)
            ends[node] = t
        self.ends = np.full(len(step) + 1, -1, np.int32)
        self.ends[list(ends)] = list(ends.values())
        self.slots = 1 << max(10, (8 * len(step)).bit_length())
        self.step_key, self.step_to = np.full(self.slots, -1, np.int64), np.zeros(self.slots, np.int32)
        key, to = (np.fromiter(x, np.int64, len(step)) for x in (step.keys(), step.values()))
        slot = self._slot(key)
        while len(key):
            free = self.step_key[slot] < 0
            _, one = np.unique(slot, return_index=True)
            put = np.zeros(len(key), bool)
            put[one] = True
            put &= free
            self.step_key[slot[put]], self.step_to[slot[put]] = key[put], to[put]
            key, to, slot = key[~put], to[~put], (slot[~put] + 1) & (self.slots - 1)

    def _slot(self, key: np.ndarray) -> np.ndarray:
        return (key * 0x1E3779B97F4A7C15 >> 20) & (self.slots - 1)

    def _steps(self, key: np.ndarray) -> np.ndarray:
        """The node after each step, 0 for none."""
        slot = self._slot(key)
        held = self.step_key[slot]
        out = np.where(held == key, self.step_to[slot], 0)
        at = np.flatnonzero((held != key) & (held >= 0))
        while len(at):  # the few whose place another step has
            nxt = (slot[at] + 1) & (self.slots - 1)
            slot[at] = nxt
            held = self.step_key[nxt]
            hit = held == key[at]
            out[at[hit]] = self.step_to[nxt[hit]]
            at = at[~hit & (held >= 0)]
        return out

    def _found(self, text: str) -> tuple[np.ndarray, np.ndarray]:
        """(end, token) of every reachable token in the text, by end, the longest first: all beginnings walk the trie at once."""
        chars = np.frombuffer(text.encode("utf-16-le"), "<u2").astype(np.int64)
        begin = np.flatnonzero(chars < 256)
        node, at, found = np.zeros(len(begin), np.int64), begin, []
        while len(at):
            node = self._steps(node << 8 | chars[at])
            live = node > 0
            node, at = node[live].astype(np.int64), at[live]
            t = self.ends[node]
            hit = t >= 0
            found.append((at[hit], t[hit]))
            at = at + 1
            go = at < len(chars)
            go[go] = chars[at[go]] < 256
            node, at = node[go], at[go]
        many = np.bincount(np.concatenate([e for e, _ in found]), minlength=len(chars)) if found else np.zeros(len(chars), np.int64)
        place = np.cumsum(many) - many
        end, token = np.repeat(np.arange(len(chars)), many), np.empty(int(many.sum()), np.int64)
        for e, t in reversed(found):
            token[place[e]] = t
            place[e] += 1
        return end, token

    def _uncrossed(self, a: np.ndarray, b: np.ndarray, until=None) -> np.ndarray:
        """For token pairs: whether no merge crosses their border while both are put together.

        Time runs backwards: of the two pieces at the border the later made is
        taken apart.  A crossing merge happens if its rank comes before both
        pieces are used up; of equal ranks the merge further left goes first.
        ``until`` leaves out the merge of that rank itself.
        """
        ok, at = np.ones(len(a), bool), np.arange(len(a))
        left_used = np.full(len(a), len(self.merge_rank))
        right_used = left_used.copy()
        while len(at):
            key = a << 32 | b
            i = np.searchsorted(self.merge_key[:-1], key)
            found = self.merge_key[i] == key
            r = self.merge_rank[np.minimum(i, len(self.merge_rank) - 1)] if len(self.merge_rank) else i
            crossed = found & (r < left_used) & (r <= right_used)
            if until is not None:
                crossed &= r != until[at]
            ok[at[crossed]] = False
            ra, rb = self.rank[a], self.rank[b]
            go = ~crossed & ((ra >= 0) | (rb >= 0))
            at, a, b, ra, rb, left_used, right_used = (x[go] for x in (at, a, b, ra, rb, left_used, right_used))
            first = ra > rb
            left_used, right_used = np.where(first, ra, left_used), np.where(first, right_used, rb)
            a, b = np.where(first, self.right[a], a), np.where(first, b, self.left[b])
        return ok

    def compatible(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """``_uncrossed`` with a table of the pairs seen last."""
        key = a << 32 | b
        slot = ((key * 0x1E3779B97F4A7C15) >> 20) & (PAIRS - 1)
        out, new = self.seen[slot], np.flatnonzero(self.seen_key[slot] != key)
        if len(new):
            out[new] = self._uncrossed(a[new], b[new])
            self.seen_key[slot[new]] = -1  # two new pairs may share a slot: set both halves from the same one
            _, one = np.unique(slot[new], return_index=True)
            self.seen_key[slot[new[one]]], self.seen[slot[new[one]]] = key[new[one]], out[new[one]]
        return out

    def prefixes(self, words: list[str]) -> list[tuple]:
        """Ids of pre-tokens (one character a byte), all of them one place at a time."""
        text = SEPARATOR.join(words)
        length = np.fromiter(map(len, words), np.int64, len(words))
        begin = np.cumsum(length + 1) - length - 1
        end, token = self._found(text)
        depth = end - np.repeat(begin, length + 1)[end]
        run = np.r_[0, np.flatnonzero(np.diff(end)) + 1]  # of the tokens that end at one place, longest first
        turn = np.arange(len(end)) - np.repeat(run, np.diff(np.r_[run, len(end)]))
        group = depth * (turn.max(initial=0) + 1) + turn
        order = np.argsort(group.astype(np.uint16) if group.max(initial=0) < 1 << 16 else group, kind="stable")
        group = group[order]
        last = np.full(len(text), -1)
        for these in np.split(order, np.flatnonzero(np.diff(group)) + 1):
            these = these[last[end[these]] < 0]
            e, t = end[these], token[these]
            ok = depth[these] < self.size[t]
            rest = np.flatnonzero(~ok)
            ok[rest] = self.compatible(last[e[rest] - self.size[t[rest]]], t[rest])
            last[e[ok]] = t[ok]
        return self._follow(last, begin, length)

    def _follow(self, last: np.ndarray, begin: np.ndarray, length: np.ndarray) -> list[tuple]:
        """The ids that the back-pointers give, from each word's end."""
        ids, word = [], []
        live, at = np.arange(len(begin)), begin + length - 1
        while len(live):
            ids.append(t := last[at])
            word.append(live)
            at = at - self.size[t]
            go = at >= begin[live]
            live, at = live[go], at[go]
        ids, word = np.concatenate(ids)[::-1], np.concatenate(word)[::-1]
        flat = ids[np.argsort(word, kind="stable")].tolist()
        stop = np.cumsum(np.bincount(word, minlength=len(begin))).tolist()
        return [tuple(flat[a:b]) for a, b in zip([0, *stop], stop)]

    def one_word(self, chars: str) -> tuple:
        """Ids of a long pre-token, place after place."""
        last, pairs, size = [-1] * len(chars), {}, self.size.tolist()
        for end, t in zip(*(x.tolist() for x in self._found(chars))):
            if last[end] < 0:
                start = end - size[t]
                pair = (last[start], t)
                if start >= 0 and pair not in pairs:
                    pairs[pair] = bool(self._uncrossed(np.array(pair[:1]), np.array(pair[1:]))[0])
                if start < 0 or pairs[pair]:
                    last[end] = t
        return self._follow(np.array(last), np.zeros(1, np.int64), np.array([len(chars)]))[0]

    def cut(self, key) -> list[str]:
        """The pre-tokens of a unit, one character a byte."""
        if isinstance(key, tuple):
            text = key[0]
        else:
            text = " " + key
            if key.isascii() and key.isalpha():
                return [text]
        if not LATER.search(text):
            return self.short(text) if text.isascii() else [w.encode().decode("latin-1") for w in self.short(text)]
        # the library's own rule: the character classes of Unicode differ from version to version
        return [text[b:e].encode().decode("latin-1") for _, (b, e) in self.library(text)]

    def fill(self, keys) -> dict:
        """Ids of all units of ``keys``, as a dict that holds them (and more)."""
        units, words = self.units, self.words
        for memo, start in ((units, self.added), (words, self.known)):
            if len(memo) >= CACHE or not memo:
                memo.clear()
                memo.update(start)
        new = set(keys).difference(units)
        cut = list(map(self.cut, new))
        missing = set(chain.from_iterable(cut)).difference(words)
        short = [w for w in missing if len(w) <= LONG]
        if short:
            words.update(zip(short, self.prefixes(short)))
        for w in missing:
            if len(w) > LONG:
                words[w] = self.one_word(w)
        units.update(zip(new, [words[c[0]] if len(c) == 1 else tuple(chain.from_iterable(map(words.__getitem__, c))) for c in cut]))
        return units


class PrefixCodec:
    """Encodes and decodes with a vocabulary; shipped with tasks."""

    def __init__(self, vocabulary: Vocabulary, added: bool = True):
        self.vocabulary, self.added = vocabulary, added
        self._cut = re.compile("(" + "|".join(map(re.escape, sorted(vocabulary.added, key=len, reverse=True))) + ")") if added and vocabulary.added else None

    @property
    def tables(self) -> _Tables:
        key = self.vocabulary.key
        if key not in _OPEN:
            _OPEN.clear()
            _OPEN[key] = _Tables(self.vocabulary)
        return _OPEN[key]

    def _keys(self, text: str) -> list:
        """The unit keys of a text, with added tokens as their ids."""
        keys: list = []
        for i, part in enumerate(self._cut.split(text) if self._cut else [text]):
            if i % 2:
                keys.append(self.vocabulary.added[part])
            elif part:
                first, *rest = UNIT.split(part)
                keys.append((first,))
                keys += rest
        return keys

    def encode_many(self, texts: list[str]) -> list[list[int]]:
        """Token ids of whole texts."""
        keys = [self._keys(t) for t in texts]
        ids = self.tables.fill(chain.from_iterable(keys)).__getitem__
        return [list(chain.from_iterable(map(ids, ks))) for ks in keys]

    def encode(self, text: str) -> list[int]:
        return self.encode_many([text])[0]

    def decode(self, ids) -> str:
        """The text of ids; bytes that are no UTF-8 become replacement characters."""
        return b"".join(map(self.vocabulary.tokens.__getitem__, ids)).decode("utf-8", "replace")


def open_codec(path: str | None = None, added: bool = True) -> PrefixCodec:
    """A codec for a tokenizer file (default: the 50k byte-level vocabulary); ``added``: strings of added tokens are those tokens."""
    return PrefixCodec(read_vocabulary(path or public_tokenizers.path(VOCABULARY)), added)


def encoded(column, codec: PrefixCodec):
    """Ids of the texts of a batch's column, a few megabytes at a time."""
    raw = utf8(column)
    for a, b in chunks(raw):
        yield from codec.encode_many([(t or b"").decode("utf-8", "replace") for t in raw[a:b]])


def encode(docs: DataFrame, codec: PrefixCodec, text: str = "text", ids: str = "ids") -> DataFrame:
    """``docs`` with the token ids of a text column (replacing a column of that name)."""
    rest = docs.drop(ids)

    def run(batches):
        for batch in batches:
            out = pa.array(encoded(batch[text], codec), pa.list_(pa.int32()))
            yield pa.RecordBatch.from_arrays([*batch.columns, out], names=[*batch.schema.names, ids])

    return rest.mapInArrow(run, StructType(list(rest.schema.fields)).add(ids, ArrayType(IntegerType())))


def decode(rows: DataFrame, codec: PrefixCodec, ids: str = "ids", out: str = "decoded") -> DataFrame:
    """``rows`` with the text of token ids, special tokens kept (null for null)."""
    rest = rows.drop(out)

    def run(batches):
        for batch in batches:
            texts = pa.array((None if x is None else codec.decode(x) for x in batch[ids].to_pylist()), pa.string())
            yield pa.RecordBatch.from_arrays([*batch.columns, texts], names=[*batch.schema.names, out])

    return rest.mapInArrow(run, StructType(list(rest.schema.fields)).add(out, StringType()))


def token_digests(docs: DataFrame, codec: PrefixCodec) -> DataFrame:
    """(doc_id, n_tokens, ids_sha256, decoded_sha256): encodes each text, decodes the ids, keeps digests only."""
    schema = (StructType().add("doc_id", docs.schema["doc_id"].dataType).add("n_tokens", LongType())
              .add("ids_sha256", StringType()).add("decoded_sha256", StringType()))

    def run(batches):
        number = list(map(str, range(len(codec.vocabulary.tokens))))
        for batch in batches:
            n, a, b = [], [], []
            for ids in encoded(batch["text"], codec):
                n.append(len(ids))
                a.append(hashlib.sha256(",".join(map(number.__getitem__, ids)).encode()).hexdigest())
                b.append(hashlib.sha256(codec.decode(ids).encode()).hexdigest())
            yield pa.RecordBatch.from_arrays([batch["doc_id"], pa.array(n, pa.int64()), pa.array(a, pa.string()), pa.array(b, pa.string())],
                                             names=schema.names)

    return docs.select("doc_id", "text").mapInArrow(run, schema)


def op11_prefix_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Token counts and digests of every document."""
    return token_digests(spark.read.parquet(f"{sf_dir}/documents.parquet"), open_codec())


QUERIES = {"op11_prefix_bpe": (op11_prefix_bpe, None)}
