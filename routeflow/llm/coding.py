"""Token ids of whole texts, with a memo of words.

A vocabulary file that drops white space and splits words by a pattern (see :func:`_pattern`) never joins characters across
a space or a line break, so a text's ids are those of its chunks in order. Arrow finds the distinct chunks of a batch, cuts
them into words, finds the distinct words, and looks those up in the memo. Words of ASCII and Latin-1 letters, digits and
marks are lowered here and go to the vocabulary's model many at a time, a word's last id being one that ends words; any
other chunk counts as one word and goes to the whole tokenizer by itself. The memo is a cache and changes no result. Any
other vocabulary file encodes whole texts.
"""

from __future__ import annotations

import json
import os

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

from routeflow.llm.storage import memos

#: Entries of the memo, and the length up to which words enter it.
MEMO, LONGEST = 240_000, 48
#: Characters whose lower case and whose place in the pattern are the same to any library; ``<`` may begin a special token.
_PLAIN = "^[!-;=-~À-ÖØ-öø-ÿ]*$"
#: Begins what stands in place of a word and isn't cut or lowered; no chunk holds a line break.
_ODD = "\n"
_coders: dict[tuple[str, int], Coder] = {}
memos.append(_coders.clear)


def _pattern(definition: dict) -> str | None:
    """The pattern of words, if texts lose their white space, are lowered, split by it and coded with word ends."""
    normal = [(n["type"], n.get("pattern")) for n in (definition.get("normalizer") or {}).get("normalizers", ())]
    steps = (definition.get("pre_tokenizer") or {}).get("pretokenizers", ())
    fine = normal == [("NFC", None), ("Replace", {"Regex": r"\s+"}), ("Lowercase", None)] and [s["type"] for s in steps] == ["Split", "ByteLevel"]
    fine = fine and steps[0]["behavior"] == "Removed" and steps[0]["invert"] and not steps[1]["add_prefix_space"] and not steps[1]["use_regex"]
    fine = fine and definition["model"]["type"] == "BPE" and definition["model"].get("end_of_word_suffix") and "Regex" in steps[0]["pattern"]
    fine = fine and all(a["content"].startswith("<") and not any(c.isspace() for c in a["content"]) and not a["lstrip"] and not a["rstrip"] for a in definition["added_tokens"])
    return steps[0]["pattern"]["Regex"] if fine else None


class Coder:
    """Encodes texts as little-endian unsigned ids of ``width`` bytes."""

    def __init__(self, path: str, width: int):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer, self.width, self.kind = Tokenizer.from_file(path), width, f"<u{width}"
        if self.tokenizer.get_vocab_size() > 1 << 8 * width:
            raise ValueError(f"ids of this vocabulary don't fit {width} bytes")
        with open(path, encoding="utf-8") as f:
            definition = json.load(f)
        self.words, pattern = None, _pattern(definition)
        if pattern is not None:
            self.pattern, end = f"({pattern})", definition["model"]["end_of_word_suffix"]
            self.ends = np.zeros(self.tokenizer.get_vocab_size(), bool)
            self.ends[[i for token, i in definition["model"]["vocab"].items() if token.endswith(end)]] = True
            definition |= {"normalizer": None, "added_tokens": [], "pre_tokenizer": {"type": "Sequence", "pretokenizers": [{"type": "WhitespaceSplit"}, definition["pre_tokenizer"]["pretokenizers"][1]]}}
            self.words = Tokenizer.from_str(json.dumps(definition))
        self.known, self.ids = pa.array([""], pa.large_string()), pa.array([b""], pa.large_binary())
        self.used, self.turn = np.zeros(1, np.int64), 0  # the turn that used each word last

    def _whole(self, texts: list[str]) -> list[bytes]:
        return [np.array(e.ids, self.kind).tobytes() for e in self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)]

    def _words(self, words: list[str]) -> list[bytes]:
        """Ids of lower-case words, coded a few hundred at a time."""
        out: list[bytes] = []
        for a in range(0, len(words), 512):
            part = words[a : a + 512]
            ids = np.array(self.words.encode_batch_fast([" ".join(part)], add_special_tokens=False)[0].ids, self.kind)
            last = np.flatnonzero(self.ends[ids]) + 1
            if len(last) != len(part):  # a word has a symbol that the vocabulary lacks
                return [np.array(e.ids, self.kind).tobytes() for e in self.words.encode_batch_fast(words, add_special_tokens=False)]
            data, cuts = ids.tobytes(), (last * self.width).tolist()
            out += [data[x:y] for x, y in zip([0, *cuts], cuts, strict=False)]
        return out

    def _ids_of(self, words: pa.Array) -> pa.Array:
        """Ids of distinct words, from the memo or learned now."""
        at = pc.index_in(words, value_set=self.known)
        missing = at.is_null()
        new = words.filter(missing)
        odd = pc.starts_with(new, _ODD)
        learned = pa.chunked_array([pa.array(self._words(new.filter(pc.invert(odd)).to_pylist()), pa.large_binary()), pa.array(self._whole([w[1:] for w in new.filter(odd).to_pylist()]), pa.large_binary())]).combine_chunks()
        new = pa.concat_arrays([new.filter(pc.invert(odd)), new.filter(odd)])
        # whichever half a new word went to, its place is that of its kind so far
        odd, n = odd.to_numpy(zero_copy_only=False), len(self.known)
        at, missing = at.fill_null(0).to_numpy().astype(np.int64), missing.to_numpy(zero_copy_only=False)
        at[missing] = n + np.where(odd, (~odd).sum() + np.cumsum(odd) - 1, np.cumsum(~odd) - 1)
        self.known, self.ids = pa.concat_arrays([self.known, new]), pa.concat_arrays([self.ids, learned])
        found = self.ids.take(pa.array(at))
        self.turn += 1
        self.used = np.append(self.used, np.zeros(len(new), np.int64))
        self.used[at] = self.turn
        keep = np.ones(len(self.used), bool)
        keep[n:] = pc.less_equal(pc.utf8_length(new), LONGEST).to_numpy(zero_copy_only=False)
        if len(keep) > MEMO:  # the half that was used last stays
            keep &= self.used >= np.partition(self.used, len(keep) // 2)[len(keep) // 2]
            keep[np.flatnonzero(keep)[MEMO:]] = False
        if not keep.all():
            keep[0] = True
            self.known, self.ids, self.used = self.known.filter(pa.array(keep)), self.ids.filter(pa.array(keep)), self.used[keep]
        return found

    def _cut(self, chunks: pa.Array) -> pa.Array:
        """Chunks with their words lowered and a space behind each word, or with a mark before them."""
        text = lambda x: pa.scalar(x, pa.large_string())
        plain = pc.match_substring_regex(chunks, _PLAIN)
        low = pc.utf8_lower(chunks.filter(plain))
        core, last = pc.utf8_slice_codeunits(low, 0, -1), pc.utf8_slice_codeunits(low, -1)
        # letters, or letters and one mark, need no pattern
        letters = pc.utf8_is_alpha(low)
        marked = pc.and_(pc.utf8_is_alpha(core), pc.invert(pc.utf8_is_alnum(last)))
        cut = pc.if_else(letters, pc.binary_join_element_wise(low, text(""), text(" ")), pc.binary_join_element_wise(core, last, text(""), text(" ")))
        rest = pc.invert(pc.or_(letters, marked))
        cut = pc.replace_with_mask(cut, rest, pc.replace_substring_regex(low.filter(rest), self.pattern, r"\1 "))
        return pc.replace_with_mask(pc.binary_join_element_wise(text(_ODD), chunks, text("")), plain, cut)

    def encode_all(self, texts: pa.Array | list[str | None]) -> list[bytes]:
        """Ids of each text; null texts have none."""
        texts = texts if isinstance(texts, pa.Array) else pa.array(texts, pa.string())
        if self.words is None:
            return self._whole([t or "" for t in texts.to_pylist()])
        if not len(texts):
            return []
        spaced = pc.replace_substring(pc.fill_null(texts.cast(pa.large_string()), ""), "\n", " ")
        parts = pc.split_pattern(spaced, " ")
        chunks = pc.dictionary_encode(parts.flatten())
        pieces = pc.split_pattern(self._cut(chunks.dictionary), " ")
        words = pc.dictionary_encode(pieces.flatten())
        of_word = self._ids_of(words.dictionary).take(words.indices)
        bounds = np.frombuffer(of_word.buffers()[1], np.int64)[pieces.offsets.to_numpy()]
        of_chunk = pa.Array.from_buffers(pa.large_binary(), len(pieces), [None, pa.py_buffer(bounds), of_word.buffers()[2]])
        ids = of_chunk.take(chunks.indices)
        data = ids.buffers()[2]
        ends = np.frombuffer(ids.buffers()[1], np.int64)[parts.offsets.to_numpy()].tolist()
        data = memoryview(data) if data is not None else b""
        return [bytes(data[a:b]) for a, b in zip(ends, ends[1:], strict=False)]

    def encode(self, text: str) -> bytes:
        return self.encode_all([text])[0]


def coder(path: str, width: int = 2) -> Coder:
    """One coder a Python worker; its memo lives on from task to task."""
    if (path, width) not in _coders:
        _coders[path, width] = Coder(path, width)
    return _coders[path, width]
