"""Byte-pair merges by the ranks of their results, for the vocabulary files whose merges this equals.

Merging the neighbours whose result has the least rank gives what the file's list of pairs gives if the ids of
the results rise along the list, and if every token that is used comes out whole when its own text is encoded:
two tokens can only stand side by side if they do so in the encoding of their concatenation, so a pair that the
list doesn't hold never has a token for a result. Both are checked when a file is loaded; tokens that do not come
out whole are never reached by the list either, and are left out.
"""

from __future__ import annotations

#: Pieces with more characters are left to the library whose merging does not grow with the square of the length.
LONGEST = 2048


def byte_symbols() -> dict[str, int]:
    """The byte for which each character of a byte-level vocabulary stands."""
    printable = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in set(printable)]
    return {chr(b): b for b in printable} | {chr(256 + k): b for k, b in enumerate(rest)}


def merged(symbols: list[str], order: dict[tuple[str, str], int]) -> list[str]:
    """The symbols after all merges of the list, the first of the list first, from left to right."""
    symbols = list(symbols)
    while len(symbols) > 1:
        first, at = min((order.get(pair, len(order)), k) for k, pair in enumerate(zip(symbols, symbols[1:], strict=False)))
        if first == len(order):
            break
        symbols[at : at + 2] = [symbols[at] + symbols[at + 1]]
    return symbols


def checked(model: dict, suffix: str = "") -> dict[str, int]:
    """Token: id of a file's model, without the tokens that its merges never reach."""
    pairs = [tuple(m) if isinstance(m, list) else tuple(m.split(" ")) for m in model["merges"]]
    vocab = model["vocab"]
    ids = [vocab[a + b] for a, b in pairs]
    if any(a >= b for a, b in zip(ids, ids[1:], strict=False)) or len(set(pairs)) != len(pairs):
        raise ValueError("the ids of this vocabulary do not follow its merges")
    order = {pair: k for k, pair in enumerate(pairs)}

    def parts(token: str) -> list[str]:
        if suffix and token.endswith(suffix):
            token = token[: -len(suffix)]
            return [*token[:-1], token[-1:] + suffix]
        return list(token)

    return {a + b: k for (a, b), k in zip(pairs, ids, strict=True) if merged(parts(a + b), order) == [a + b]}
