"""Byte-pair encoding of whole texts in one call of tiktoken's core, for tokenizer files whose merges it follows exactly.

tiktoken's core merges the pair whose joined bytes are the earliest token. Where every token encodes to itself, two
neighbours that come about under the file's merges and together are a token are always that token's own merge (the
token's bytes alone would stop at the two otherwise), so with ids in the order of merges both do the same. These
conditions are checked; `ranks_of` returns None for a file without them.

A suffix that marks the end of a word is the byte END after it. Its pairs with the bytes before it are the earliest
tokens of two bytes, so they are joined before any merge."""

from __future__ import annotations

from tastemill.llm.token_counts import byte_letters

END = "\x01"
LATIN_END = "\u0250"  # letters below it are letters to every version of Unicode
LATIN = "".join(c for c in map(chr, range(0xA1, ord(LATIN_END))) if c != "\u0130")  # its lower case is two characters
LETTERS = "".join(sorted({x for c in map(chr, range(ord(LATIN_END))) if c.isalpha() and c != "\u0130" for x in (c, c.lower())}))
NUMBERS = "0-9\xb2\xb3\xb9\xbc-\xbe"
SPLIT = r"'s|'t|'re|'ve|'m|'ll|'d"


def ranks_of(spec: dict) -> dict[bytes, int] | None:
    """The bytes of each token of a byte-level BPE file and its id."""
    from tokenizers.models import BPE

    model, letters = spec["model"], byte_letters()
    suffix = model.get("end_of_word_suffix") or ""
    if model.get("type") != "BPE" or any(model.get(k) for k in ("dropout", "continuing_subword_prefix", "byte_fallback", "ignore_merges")):
        return None
    symbols = {c: (c, bytes([b])) for b, c in letters.items()}
    ends = {c + suffix: (chr(0xE000 + b), bytes([b]) + END.encode()) for b, c in letters.items()} if suffix else {}

    def cut(token: str) -> list[tuple[str, bytes]]:
        """Each symbol of a token as one character and as bytes."""
        end = ends.get(token[-1 - len(suffix) :]) if suffix else None
        return [symbols[c] for c in (token[: -1 - len(suffix)] if end else token)] + [end] * bool(end)

    added = {t["content"] for t in spec.get("added_tokens", [])}
    try:
        tokens = {t: list(zip(*cut(t))) for t in model["vocab"] if t not in added}
    except KeyError:
        return None
    ids = {"".join(x): model["vocab"][t] for t, (x, _) in tokens.items()}
    ranks = {b"".join(y): model["vocab"][t] for t, (_, y) in tokens.items()}
    pairs = [m.split(" ") if isinstance(m, str) else m for m in model["merges"]]
    if not all(x in tokens and y in tokens and x + y in tokens for x, y in pairs):
        return None
    made, bases = [model["vocab"][x + y] for x, y in pairs], [x for x, _ in (*symbols.values(), *ends.values())]
    first = [ids.get(x, -1) for x in bases]
    if -1 in first or len(ranks) < len(ids) or not all(x < y for x, y in zip([max(first), *made], made)) or sorted(first + made) != sorted(ids.values()):
        return None
    joined = lambda t: "".join(tokens[t][0])
    alone = BPE(ids, [(joined(x), joined(y)) for x, y in pairs])
    return ranks if all([t.id for t in alone.tokenize(x)] == [i] for x, i in ids.items()) else None


def core_of(ranks: dict[bytes, int], pattern: str):
    """A function from a text to its ids as a buffer of unsigned 32-bit numbers."""
    import tiktoken

    never = END * 2  # a special string, so that the core does not stop at every character to look for one
    core = tiktoken.Encoding("of a file", pat_str=pattern, mergeable_ranks=ranks, special_tokens={never: max(ranks.values()) + 1})._core_bpe
    none = frozenset()
    return lambda text: core.encode_to_tiktoken_buffer(text, none)
