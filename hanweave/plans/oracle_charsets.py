"""DuckDB statements for legacy charsets, which DuckDB lacks.

Code tables come from Python's codecs (they differ from the JVM's in the private area of
GBK and in some compatibility signs, which the documents don't hold), bytes are upper-case hex digits, and a text goes
through a chain of common table expressions, sign by sign.  Malformed bytes become U+FFFD
as in the JVM's decoders: a lead byte takes the next byte with it into one U+FFFD, unless
that is a lead byte or a character by itself.
"""

from __future__ import annotations

from functools import lru_cache

CODECS = {"gbk": "gbk", "big5": "cp950", "shift-jis": "cp932", "gb2312": "gb2312"}


def _text(value: str) -> str:
    return "'" + value.replace("'", "''") + "'"


@lru_cache(maxsize=None)
def _codes(charset: str) -> tuple[dict[str, str], dict[str, str]]:
    """(character to hex, hex to character) beyond ASCII."""
    codec = CODECS[charset]
    out, back = {}, {}
    for code in range(0x80, 0x10000):
        if 0xD800 <= code < 0xE000:
            continue
        try:
            out[chr(code)] = chr(code).encode(codec).hex().upper()
        except UnicodeEncodeError:
            pass
    for a in range(0x80, 0x100):
        for data in (bytes([a]), *(bytes([a, b]) for b in range(0x100))):
            try:
                char = data.decode(codec)
            except UnicodeDecodeError:
                continue
            if len(char) == 1 and data.hex().upper() not in NOT_SINGLE.get(charset, ()):
                back[data.hex().upper()] = char
    own = _own(charset)
    return out | {c: h for h, c in own.items()}, back | own


def _class(values) -> str:
    """Bytes as an expression on two hex digits."""
    by_high: dict[int, list[int]] = {}
    for v in sorted(values):
        by_high.setdefault(v >> 4, []).append(v & 15)
    by_low: dict[tuple[int, ...], list[int]] = {}
    for high, low in by_high.items():
        by_low.setdefault(tuple(low), []).append(high)
    sets = ["[" + "".join(f"{h:X}" for h in high) + "][" + "".join(f"{x:X}" for x in low) + "]" for low, high in by_low.items()]
    return "(?:" + "|".join(sets) + ")"


#: Single bytes of Python's table that the JVM's has not.  Fixed values.
NOT_SINGLE = {"shift-jis": ("A0", "FD", "FE", "FF")}
#: Users' own areas of Big5: first and last code, and the private character of the first.  Fixed values.
OWN_AREAS = {"big5": ((0xFA40, 0xFEFE, 0xE000), (0x8E40, 0xA0FE, 0xE311), (0x8140, 0x8DFE, 0xEEB8), (0xC6A1, 0xC8FE, 0xF6B1))}


def _own(charset: str) -> dict[str, str]:
    """Hex to private characters, counted through the valid trail bytes."""
    found = {}
    for first, last, char in OWN_AREAS.get(charset, ()):
        codes = [c for c in range(first, last + 1) if 0x40 <= c & 0xFF <= 0x7E or 0xA1 <= c & 0xFF <= 0xFE]
        found |= {f"{c:04X}": chr(char + i) for i, c in enumerate(codes)}
    return found


@lru_cache(maxsize=None)
def _tokens(charset: str) -> str:
    _, back = _codes(charset)
    single = set(range(0x80)) | {int(k, 16) for k in back if len(k) == 2}
    pairs: dict[int, set[int]] = {}
    for k in back:
        if len(k) == 4:
            pairs.setdefault(int(k[:2], 16), set()).add(int(k[2:], 16))
    by_trail: dict[frozenset, list[int]] = {}
    for lead, trail in pairs.items():
        by_trail.setdefault(frozenset(trail), []).append(lead)
    parts = [_class(leads) + _class(trail) for trail, leads in by_trail.items()]
    parts.append(_class(single))
    neither = set(range(0x100)) - single - set(pairs)
    if neither:
        parts.append(_class(pairs) + _class(neither))
    return "|".join(parts) + "|.."


def _table(rows: dict[str, str]) -> str:
    """(k, v) rows of two aligned lists."""
    keys, values = ",".join(f"{ord(k):X}" if len(k) == 1 else k for k in rows), ",".join(v if len(v) > 1 else f"{ord(v):X}" for v in rows.values())
    return f"(SELECT unnest(string_split({_text(keys)}, ',')) AS k, unnest(string_split({_text(values)}, ',')) AS v)"


class Chain:
    """Steps over one value a document: (doc_id, v)."""

    def __init__(self, source: str):
        self.steps = [f"s0 AS ({source})"]

    @property
    def last(self) -> str:
        return f"s{len(self.steps) - 1}"

    def _add(self, query: str) -> Chain:
        self.steps.append(f"s{len(self.steps)} AS ({query})")
        return self

    def map(self, value: str) -> Chain:
        """A scalar expression of v."""
        return self._add(f"SELECT doc_id, {value} AS v FROM {self.last}")

    def _apart(self, parts: str, one: str, join: str = "") -> Chain:
        spread = f"SELECT doc_id, unnest(l) AS t, unnest(range(len(l))) AS p FROM (SELECT doc_id, {parts} AS l FROM {self.last})"
        joined = f"SELECT doc_id, string_agg({one}, '' ORDER BY p) AS v FROM ({spread}) x {join} WHERE t <> '' GROUP BY doc_id"
        return self._add(f"SELECT a.doc_id AS doc_id, CASE WHEN a.v IS NULL THEN NULL ELSE coalesce(b.v, '') END AS v FROM {self.last} a LEFT JOIN ({joined}) b ON a.doc_id = b.doc_id")

    def unless_held(self, charset: str, other: dict[str, str] | str) -> Chain:
        """Characters that a charset holds as they are; others by a table of characters, or one sign for all."""
        out, back = _codes(charset)
        own = {c: h for c, h in out.items() if back.get(h) == c}
        known = f"LEFT JOIN {_table(own)} m ON printf('%X', unicode(t)) = m.k"
        if isinstance(other, str):
            return self._apart("string_split(v, '')", f"CASE WHEN unicode(t) < 128 OR m.k IS NOT NULL THEN t ELSE {_text(other)} END", known)
        mapped = "coalesce(chr(CAST('0x' || n.v AS INTEGER)), t)"
        return self._apart("string_split(v, '')", f"CASE WHEN unicode(t) < 128 OR m.k IS NOT NULL THEN t ELSE {mapped} END", f"{known} LEFT JOIN {_table(other)} n ON printf('%X', unicode(t)) = n.k")

    def encoded(self, charset: str) -> Chain:
        """Text to hex digits; what the charset lacks becomes a question mark."""
        if charset == "hz":
            out, _ = _codes("gb2312")
            seven = {k: f"{int(v, 16) - 0x8080:04X}" for k, v in out.items()}
            plain = "CASE WHEN t = '~' THEN '7E7E' WHEN unicode(t) < 128 THEN printf('%02X', unicode(t)) ELSE '3F' END"
            self._apart("string_split(v, '')", f"CASE WHEN m.v IS NULL THEN {plain} ELSE '<7E7B' || m.v || '7E7D>' END", f"LEFT JOIN {_table(seven)} m ON printf('%X', unicode(t)) = m.k")
            return self.map("replace(replace(replace(v, '7E7D><7E7B', ''), '<', ''), '>', '')")
        plain = "CASE WHEN unicode(t) < 128 THEN printf('%02X', unicode(t)) ELSE '3F' END"
        return self._apart("string_split(v, '')", f"coalesce(m.v, {plain})", f"LEFT JOIN {_table(_codes(charset)[0])} m ON printf('%X', unicode(t)) = m.k")

    def latin1(self) -> Chain:
        """Text to hex digits by Latin-1."""
        return self._apart("string_split(v, '')", "CASE WHEN unicode(t) < 256 THEN printf('%02X', unicode(t)) ELSE '3F' END")

    def decoded(self, charset: str) -> Chain:
        """Hex digits to text."""
        if charset == "latin1":
            return self._apart("regexp_extract_all(v, '..')", "chr(CAST('0x' || t AS INTEGER))")
        if charset == "hz":  # no bytes of these tables open a stretch of pairs
            sign = "CASE WHEN t = '7E7E' THEN '~' WHEN t = '7E0A' THEN '' WHEN t >= '80' OR t = '7E' THEN chr(65533) ELSE chr(CAST('0x' || t AS INTEGER)) END"
            return self._apart("regexp_extract_all(v, '7E7E|7E0A|..')", sign)
        back = _codes(charset)[1]
        plain = "CASE WHEN length(t) = 2 AND t < '80' THEN chr(CAST('0x' || t AS INTEGER)) ELSE chr(65533) END"
        # \u0000 can't be built from a literal's escape, and no table has it
        return self._apart(f"regexp_extract_all(v, '{_tokens(charset)}')", f"coalesce(chr(CAST('0x' || m.v AS INTEGER)), {plain})", f"LEFT JOIN {_table(back)} m ON t = m.k")

    def done(self, select: str = "SELECT doc_id, v AS text FROM {}") -> str:
        return "WITH " + ", ".join(self.steps) + " " + select.format(self.last)
