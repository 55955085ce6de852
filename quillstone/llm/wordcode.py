"""Whole texts to token ids through the `tokenizers` library, by way of the distinct words of a batch.

The 49k word tokenizer never joins characters across a space or line feed: its normaliser only composes characters,
folds case and white space, and its splitter drops white space. So a text's ids are those of its pieces between spaces
and line feeds, one after the other, and each distinct piece is encoded once for many occurrences. Other white space
stays inside the pieces and is left to the library. A full stop or comma right after a Latin letter starts a piece of its
own: the splitter ends a run of letters there in any case.

Texts are cut and their distinct pieces numbered by Arrow; ids are then gathered by number, so no Python object is made
for an occurrence of a piece. Pieces of letters alone go to the library many at a time between spaces: each is one run
for the splitter, whose last id has the end-of-word mark. All others go between two end-of-text strings.
"""

from __future__ import annotations

import sys
import types

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

#: A special string that the library cuts a text at before it normalises anything, and the pieces put between two of them at once.
END, RUN = "<|endoftext|>", 1000
#: Fixed by the tokenizer: the mark of ids that end a run.
WORD_END = "</w>"


def tokenizer_path(name: str = "word_bpe_49k.json") -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


#: Bytes of text whose pieces are in memory together (one text at least).
PART = 4_000_000
#: Where a piece ends although no space follows, and what is put there.
_STOP, _CUT = r"([a-z])([.,])", r"\1 \2"


class WordEncoder:
    """encode(texts) -> for each text the little-endian bytes of its ids.

    Pieces met in one batch are held `young`; those met again in a later batch are kept as `known`. Both are emptied at
    a size, which bounds memory and changes no result.
    """

    def __init__(self, path: str | None = None, known: int = 300_000, young: int = 200_000, dtype: str = "<u2"):
        import os

        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path or tokenizer_path())
        self.dtype, self.most = np.dtype(dtype), (known, young)
        self.known, self.young = {"": b""}, {}
        self.end = self.tokenizer.token_to_id(END)
        vocabulary = self.tokenizer.get_vocab()
        self.closes = np.zeros(max(vocabulary.values()) + 1, dtype=bool)
        self.closes[[i for t, i in vocabulary.items() if t.endswith(WORD_END)]] = True

    def _ids(self, text: str) -> np.ndarray:
        return np.asarray(self.tokenizer.encode_batch_fast([text], add_special_tokens=False)[0].ids, dtype=self.dtype)

    def _fresh(self, new: list[str]) -> dict[str, bytes]:
        codes, plain, others = {}, [], []
        for w in new:
            if w.isalpha() and (w.isascii() or w.lower().isalpha()):
                plain.append(w)
            elif "<|" in w:  # may hold the special strings themselves
                codes[w] = np.asarray(self.tokenizer.encode(w, add_special_tokens=False).ids, dtype=self.dtype).tobytes()
            else:
                others.append(w)
        for i in range(0, len(plain), RUN):
            part = plain[i : i + RUN]
            ids = self._ids(" ".join(part))
            ends = np.flatnonzero(self.closes[ids]) + 1
            if len(ends) != len(part):  # a tokenizer without such marks
                others += part
                continue
            self._cut(codes, part, ids, np.append(0, ends[:-1]), ends)
        for i in range(0, len(others), RUN):
            part = others[i : i + RUN]
            ids = self._ids(END.join(part))
            cut = np.flatnonzero(ids == self.end)
            self._cut(codes, part, ids, np.append(0, cut + 1), np.append(cut, len(ids)))
        return codes

    def _cut(self, codes: dict[str, bytes], part: list[str], ids: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> None:
        raw, size = ids.tobytes(), ids.itemsize
        codes.update((w, raw[a:b]) for w, a, b in zip(part, (starts * size).tolist(), (ends * size).tolist(), strict=True))

    def encode(self, texts: pa.Array | list[str | None]) -> list[bytes]:
        """In parts of about PART bytes, one text at least, whose pieces are in memory together."""
        texts = pc.fill_null(texts if isinstance(texts, pa.Array) else pa.array(texts, pa.string()), "")
        size = np.cumsum(pc.binary_length(texts).to_numpy(zero_copy_only=False).astype(np.int64))
        cuts = np.flatnonzero(np.diff(size // PART)) + 1
        out: list[bytes] = []
        for a, b in zip([0, *cuts.tolist()], [*cuts.tolist(), len(texts)], strict=True):
            out += self._encode(texts.slice(a, b - a)) if b > a else []
        return out

    def _encode(self, texts: pa.Array) -> list[bytes]:
        split = pc.split_pattern(pc.replace_substring_regex(pc.replace_substring(texts, "\n", " "), _STOP, _CUT), " ")
        pieces = split.flatten().dictionary_encode()
        words = pieces.dictionary.to_pylist()
        codes, again, new = [], {}, []
        for w in words:
            if (code := self.known.get(w)) is None:
                if (code := self.young.get(w)) is None:
                    new.append(w)
                else:
                    again[w] = code
            codes.append(code)
        fresh = self._fresh(new)
        codes = [fresh[w] if c is None else c for w, c in zip(words, codes, strict=True)] if new else codes
        if len(self.known) > self.most[0]:
            self.known = {"": b""}
        if len(self.young) > self.most[1]:
            self.young = {}
        self.known.update(again)
        self.young.update(fresh)
        # The ids of each piece, gathered by its number.
        ids, unit = np.frombuffer(b"".join(codes), dtype=self.dtype), self.dtype.itemsize
        lengths = np.fromiter(map(len, codes), dtype=np.int32, count=len(codes)) // unit
        starts = np.cumsum(lengths, dtype=np.int32) - lengths
        number = pieces.indices.to_numpy(zero_copy_only=False)
        n = lengths[number]
        ends = np.cumsum(n, dtype=np.int32)  # a part's ids are far below 2^31, or it is one text of under 2 GB
        flat = ids[np.repeat(starts[number] - (ends - n), n) + np.arange(ends[-1] if len(ends) else 0, dtype=np.int32)].tobytes()
        per = np.cumsum(pc.list_value_length(split).to_numpy(zero_copy_only=False))
        bounds = (np.append(0, ends)[per] * unit).tolist()
        return [flat[a:b] for a, b in zip([0, *bounds[:-1]], bounds, strict=True)]


def shared_encoder(path: str, dtype: str) -> WordEncoder:
    """One encoder for all tasks that a worker process runs, so that the tokenizer loads once and known pieces stay known."""
    held = sys.modules.setdefault("_quillstone_encoders", types.ModuleType("_quillstone_encoders")).__dict__
    if (path, dtype) not in held:
        held[path, dtype] = WordEncoder(path, dtype=dtype)
    return held[path, dtype]
