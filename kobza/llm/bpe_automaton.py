"""BPE encoding and decoding by a tokenization automaton.

The merges are compiled, in their order, into a deterministic automaton over tokens that accepts exactly the token
sequences that the merge procedure can return. Before any merge every state has an arc for each base symbol. The gadget of
merge ``k``, ``u + v -> w``, takes the arc ``v`` from the state behind ``u``, and adds the arc ``w`` beside every arc ``u``
that still has ``v`` behind it; ``w`` leads where ``v`` led, so the state behind ``w`` starts as a copy of the state behind
``v``. A state is stored as the arcs that it has lost (with the merge that took each); an added arc is stored as the
arc beside which it was added, and the merge that added it. So the arc ``t`` leaves a state if ``t`` was not taken from it,
and neither was any arc on the chain of left halves of ``t`` before the next arc of the chain was added beside it.

Words are read letter by letter through a transition table over all labels (goto, failure and output links). Each prefix of
a word has exactly one accepted token sequence, so at each letter just one of the labels that end there follows the
sequence of the prefix before it: the first one whose arc the automaton has, the longest first. Nothing is taken back. Decoding emits
the labels of the arcs.
"""

from __future__ import annotations

import hashlib
import json
from collections import deque
from collections.abc import Callable, Iterator

import pyarrow as pa
import regex
from pyspark.sql import DataFrame

from kobza.llm.common import trimmed

#: Fixed values of the byte-level alphabet: printable bytes stand for themselves, the others from U+0100 on.
PRINTABLE = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
WORDS = r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"
SCHEMA = "n_tokens long, ids_sha256 string, decoded_sha256 string"
#: Added to the code point of a word's last letter.
LAST = 0x1000
#: Distinct chunks that one task remembers; beyond it the memory is emptied, which costs time only.
MEMORY = 400_000


def byte_letters() -> list[str]:
    others = iter(range(0x100, 0x200))
    return [chr(b) if b in set(PRINTABLE) else chr(next(others)) for b in range(256)]


class Automaton:
    """Compiled merges of one vocabulary whose words end in a suffix."""

    def __init__(self, vocab: dict[str, int], merges: list[tuple[str, str]], suffix: str):
        self.suffix = suffix
        self.label = {i: t for t, i in vocab.items()}
        #: By state (the token read last): the arcs that it has lost, by the merge that took each.
        self.lost: dict[int, dict[int, int]] = {i: {} for t, i in vocab.items() if len(t.removesuffix(suffix) if len(t) > 1 else t) == 1}
        #: By token: the arc beside which its arcs were added, and the merge that added them; none for base symbols.
        self.beside: dict[int, tuple[int, int] | None] = dict.fromkeys(self.lost)
        for k, (a, b) in enumerate(merges):
            self.gadget(k, vocab[a], vocab[b], vocab[a + b])
        self.compile_labels()

    @classmethod
    def load(cls, path: str) -> Automaton:
        with open(path, encoding="utf-8") as file:
            model = json.load(file)["model"]
        return cls(model["vocab"], [tuple(m) for m in model["merges"]], model["end_of_word_suffix"] or "")

    def gadget(self, k: int, u: int, v: int, w: int) -> None:
        if u not in self.lost or v not in self.lost or not self.has_arc(u, v):
            return  # no sequence has this pair any more
        if w not in self.lost:
            self.lost[w] = dict(self.lost[v])
            self.beside[w] = u, k
        self.lost[u][v] = k

    def has_arc(self, state: int, token: int) -> bool:
        lost, beside = self.lost[state], self.beside
        if token in lost:
            return False
        half = beside[token]
        while half is not None:
            below, added = half
            if lost.get(below, added + 1) <= added:
                return False
            half = beside[below]
        return True

    def compile_labels(self) -> None:
        """Transitions over letters: a label's last letter is another letter if a word ends with it."""
        goto: list[dict[str, int]] = [{}]
        self.token, self.length = [-1], [0]
        for i in self.lost:
            label = self.label[i]
            ends = len(label) > len(self.suffix) and label.endswith(self.suffix)
            letters = self.letters_of(label.removesuffix(self.suffix)) if ends else label
            at = 0
            for letter in letters:
                if letter not in goto[at]:
                    goto[at][letter] = len(goto)
                    goto.append({})
                    self.token.append(-1)
                    self.length.append(0)
                at = goto[at][letter]
            self.token[at], self.length[at] = i, len(letters)
        self.goto, self.failure, self.output = goto, [0] * len(goto), [0] * len(goto)
        queue = deque(goto[0].values())
        while queue:  # breadth first, so that failures of shorter labels are known
            at = queue.popleft()
            for letter, to in goto[at].items():
                back = self.failure[at]
                while back and letter not in goto[back]:
                    back = self.failure[back]
                back = self.failure[to] = goto[back].get(letter, 0) if at else 0
                self.output[to] = back if self.token[back] >= 0 else self.output[back]
                queue.append(to)

    @staticmethod
    def letters_of(word: str) -> str:
        return word[:-1] + chr(ord(word[-1]) + LAST)

    def encode_word(self, word: str) -> list[int]:
        """word: letters of the byte-level alphabet, not empty."""
        goto, failure, output, token, length, has_arc = self.goto, self.failure, self.output, self.token, self.length, self.has_arc
        last = [-1]  # by the number of letters read: the last token of the sequence accepted so far, and its length
        lengths = [0]
        at = 0
        for n, letter in enumerate(self.letters_of(word) if self.suffix else word, 1):
            while at and letter not in goto[at]:
                at = failure[at]
            at = goto[at].get(letter, 0)
            ending = at if token[at] >= 0 else output[at]
            while ending:
                before = n - length[ending]
                if not before or has_arc(last[before], token[ending]):
                    break
                ending = output[ending]
            if not ending:
                raise ValueError(f"a symbol outside the vocabulary in {word!r}")
            last.append(token[ending])
            lengths.append(length[ending])
        out, n = [], len(word)
        while n:
            out.append(last[n])
            n -= lengths[n]
        return out[::-1]

    def decode(self, ids: list[int]) -> str:
        return " ".join([self.label[i] for i in ids])


class Chunks(dict):
    """Ids and labels as text, and their number, by chunk; found at the first lookup."""

    def __init__(self, find: Callable[[str], tuple[str, str, int]]):
        self.find = find

    def __missing__(self, chunk: str) -> tuple[str, str, int]:
        self[chunk] = got = self.find(chunk)
        return got


class WordCodec:
    """Encodes and decodes whole texts; chunks between white space are remembered."""

    def __init__(self, path: str, automaton: Automaton | None = None):
        from tokenizers import Tokenizer

        self.automaton = automaton or Automaton.load(path)
        self.library = Tokenizer.from_file(path)  # its normalizer and its split of unusual scripts
        with open(path, encoding="utf-8") as file:
            self.special = {t["content"]: t["id"] for t in json.load(file)["added_tokens"]}
        self.automaton.label |= {i: text for text, i in self.special.items()}
        self.letters = byte_letters()
        self.words = regex.compile(WORDS)
        self.cut = regex.compile("|".join(map(regex.escape, self.special)) or r"(?!)")
        self.chunks, self.known = Chunks(self.chunk), Chunks(self.word)

    def split(self, chunk: str) -> list[str]:
        """A chunk's words in the byte-level alphabet."""
        if chunk.isascii() and chunk.isprintable():
            return self.words.findall(chunk.lower())
        if max(chunk) < "ɐ":
            words = self.words.findall(chunk.lower())
        else:
            words = []
            text = self.library.normalizer.normalize_str(chunk)
            return [w for w, _ in self.library.pre_tokenizer.pre_tokenize_str(text)]
        letters = self.letters
        return ["".join([letters[b] for b in w.encode()]) for w in words]

    def chunk(self, chunk: str) -> tuple[str, str, int]:
        if isinstance(chunk, tuple):  # a special token
            return str(self.special[chunk[0]]), chunk[0], 1
        got = [self.known[word] for word in self.split(chunk)]
        return got[0] if len(got) == 1 else (" ".join([g[0] for g in got]), " ".join([g[1] for g in got]), sum([g[2] for g in got]))

    def word(self, word: str) -> tuple[str, str, int]:
        ids = self.automaton.encode_word(word)
        return " ".join(map(str, ids)), self.automaton.decode(ids), len(ids)

    def pieces(self, text: str) -> list[str]:
        if any(c in text for c in "\x1c\x1d\x1e\x1f"):  # white space for str.split alone
            return regex.split(r"[\s--\x1c-\x1f]+", text, flags=regex.V1)
        return text.split()

    def run(self, text: str) -> tuple[tuple[str, ...], tuple[str, ...], int]:
        parts, chunks = [], self.chunks
        if "<|" in text and (marks := list(self.cut.finditer(text))):
            at = 0
            for m in marks:
                parts += self.pieces(text[at : m.start()]) + [(m[0],)]
                at = m.end()
            parts += self.pieces(text[at:])
        else:
            parts = self.pieces(text)
        for known in (chunks, self.known):
            if len(known) > MEMORY:
                known.clear()
        got = list(map(chunks.__getitem__, parts))
        ids, decoded, n = zip(*got, strict=True) if got else ((), (), ())
        return ids, decoded, sum(n)

    def encode(self, text: str | None) -> list[int]:
        return [int(i) for x in self.run(text or "")[0] for i in x.split(" ")]

    def digest(self, text: str | None) -> tuple[int, str, str]:
        ids, decoded, n = self.run(text or "")
        return n, hashlib.sha256(" ".join(ids).encode()).hexdigest(), hashlib.sha256(" ".join(decoded).encode()).hexdigest()


def _mapped(df: DataFrame, path: str, text: str, key: str, names: list[str], schema: str, of: Callable) -> DataFrame:
    key_type = df.schema[key].dataType.simpleString()
    # Compiled once; its size is the vocabulary's.
    automaton = df.sparkSession.sparkContext.broadcast(Automaton.load(path))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codec = None
        for batch in batches:
            codec = codec or WordCodec(path, automaton.value)
            rows = [of(codec, t) for t in batch.column(1).to_pylist()]
            columns = list(zip(*rows, strict=True)) if rows else [()] * len(names)
            yield pa.RecordBatch.from_arrays([batch.column(0), *map(pa.array, columns)], names=[key, *names]) if rows else pa.RecordBatch.from_pylist([])

    return df.select(key, text).mapInArrow(trimmed(run), f"{key} {key_type}, {schema}")


def encode_documents(df: DataFrame, path: str, text: str = "text", key: str = "doc_id") -> DataFrame:
    """Per document the ids and the decoded text, by the vocabulary file at path.

    Null and empty texts give no ids and an empty decoded text; very long texts and words take time in proportion to their
    length. Rows are independent, so repeated rows, ties and further columns (which are not read, whatever their names)
    have no effect; an empty table gives an empty one.
    """

    def both(codec: WordCodec, t: str | None) -> tuple[list[int], str]:
        ids = codec.encode(t)
        return ids, codec.automaton.decode(ids)

    return _mapped(df, path, text, key, ["ids", "decoded"], "ids array<long>, decoded string", both)


def encode_digests(df: DataFrame, path: str, text: str = "text", key: str = "doc_id") -> DataFrame:
    """As encode_documents, as counts and SHA-256 digests."""
    return _mapped(df, path, text, key, ["n_tokens", "ids_sha256", "decoded_sha256"], SCHEMA, lambda codec, t: codec.digest(t))
