"""HTML body → markdown with its structure.

``functions.html`` turns tags into marks one by one; lists in lists, quotes,
tables and emphasis need to know what is open.  Here the tags that matter are
folded over a stack of open elements, in a small function on an Arrow column;
the other steps are column expressions:

* ``script`` and ``style`` go with their content, to the end of the body when
  they are not closed; comments, ``meta``, ``link`` and all attributes go;
* a closing tag closes what was opened inside its element, and is ignored when
  nothing of its kind is open; an ``li``, ``tr`` or ``td`` ends the one before
  it (so a closing tag right before one of these needs no step); what is open
  at the end is closed;
* ``ul`` items start with ``* ``, ``ol`` items with their number, indented to
  the text of the item around them; ``blockquote`` lines start with ``> ``;
* ``b``/``strong`` become ``**``, ``i``/``em`` ``*``, ``code`` a backtick, with
  spaces moved outside the marks and empty pairs dropped;
* a table is one line a row, with a rule below the first; line breaks in a
  cell become spaces;
* headings, line breaks and other blocks as in ``functions.html``; named and
  numeric references are decoded in one pass.

Known limits: ``>`` inside a quoted attribute ends the tag; source line breaks
stay line breaks.  The fold's steps are as many as such tags.
"""

from __future__ import annotations

import sys
from collections.abc import Iterator
from html.entities import name2codepoint

import pyarrow as pa
from pyspark import cloudpickle
from pyspark.sql import Column
from pyspark.sql import functions as F

from .. import config as cfg
from .common import any_contains, let
from .html import ATTRS_RX, BLANKS_RX, EDGE_SPACE_RX, HEADING_RX, SPACES_RX, strip_css
from .text import py_strip

HEAD, B_ON, B_OFF, I_ON, I_OFF, CUT = "\u0001", "\u0002", "\u0003", "\u0004", "\u0005", "\u0006"
GONE_RX = (r"(?is)<!--.*?-->|<script\b[^>]*>.*?(?:</script\s*>|\z)|<style\b[^>]*>.*?(?:</style\s*>|\z)"
           r"|<(?:meta|link)\b[^>]*>|<[!?][^>]*>")
KEPT = "ul|ol|li|blockquote|table|tr|td|th|b|strong|i|em|code"
KEPT_RX = rf"(?i)<(/?(?:{KEPT}))/?>"
BREAK_RX = (r"(?i)</?(?:p|div|br|hr|thead|tbody|tfoot|article|section|header|footer|nav|main|aside|pre|title|head|body|html"
            r"|form|fieldset|figure|figcaption|address|dl|dt|dd|center)/?>|</h[1-6]>")
OTHER_RX = rf"(?i)</?(?!(?:{KEPT})>)[a-z][a-z0-9:\-]*/?>|<[a-z/][^>]*\z"
#: A closing tag right before a tag that closes the same element itself.
IMPLIED_RX = r"(?i)</(?:t[dh]>(?=\s*<(?:t[dh]|/?tr|/table)>)|tr>(?=\s*<(?:tr|/table)>)|li>(?=\s*<(?:li|/[uo]l)>))"
REFERENCE_RX = r"&(?:#[0-9]{1,7}|#[xX][0-9a-fA-F]{1,6}|[A-Za-z][A-Za-z0-9]{1,31});|[^&]+|&"

#: One letter a tag; a closing tag has the capital one.
LETTERS = {"ul": "u", "ol": "o", "li": "l", "blockquote": "q", "table": "t", "tr": "r", "td": "d", "th": "d", "b": "b", "strong": "b", "i": "i", "em": "i", "code": "c"}
CODES = {f"<{tag}>".encode(): letter.encode() for tag, letter in LETTERS.items()} | {f"</{tag}>".encode(): letter.upper().encode() for tag, letter in LETTERS.items()}
#: The stack is a string with the innermost element first: u, o lists; 2 to 9
#: items, by the width of their mark; q quote; t table, r row, d cell; b, i, c
#: marks.  Capitals are the same without an effect of their own: Q in a cell,
#: B, I, C inside one of their kind; R is a row with a rule to come below it.
SAME = bytes.maketrans(b"3456789QRBIC", b"2222222qrbic")
COUNTED = b"otrR"    # with a counter each: items, rows, cells
SPACE = b" \t\r\n\x0b\x0c"
MARKS = {b"b": B_ON.encode(), b"i": I_ON.encode(), b"c": b"`"}
ENDS = ((b"b", B_OFF.encode()), (b"i", I_OFF.encode()), (b"c", b"`"), (b"d", b" |"))
BLOCKS, ROWS = (b"u", b"o", b"q", b"t"), (b"r", b"d")
#: The element that an opening tag closes, and the one around both.
AROUND = {b"l": (b"2", b"u"), b"r": (b"r", b"t"), b"d": (b"d", b"r")}


def _plain(st: bytes) -> bytes:
    return st.translate(SAME)


def _counters(st: bytes) -> int:
    return len(st) - len(st.translate(None, COUNTED))


def _prefix(st: bytes) -> bytes:
    """What each line starts with inside the open quotes and items."""
    lines = st[::-1].translate(None, b"uotrdbicQRBIC")
    return b"".join([b"> " if c == ord("q") else b" " * (c - ord("0")) for c in lines]) if lines else b""


def _line(st: bytes) -> bytes:
    """A line break there: a space in a cell."""
    return b" " if b"d" in st else b"\n" + _prefix(st)


def _gap(st: bytes) -> bytes:
    """The break around lists, quotes and tables: a line more outside items."""
    return _line(st) if b"d" in st or b"2" in _plain(st) else b"\n" + _line(st)


def _closed(st: bytes, popped: bytes, cnt: list[int]) -> bytes:
    """What the closing of the popped elements adds: ends of marks and cells,
    and the rule below a table's first row."""
    x = popped.translate(None, b"uotrqQBIC23456789")
    for letter, end in ENDS:
        x = x.replace(letter, end)
    if b"R" in x:
        cells = cnt[_counters(popped[:popped.index(b"R")])]
        x = x.replace(b"R", b"\n" + _prefix(st) + b"|" + b" --- |" * cells)
    return x


def _first_of(st: bytes, own: bytes, wall: bytes) -> int:
    """Elements to close before an ``li``, ``tr`` or ``td``: up to the open one
    of its kind, unless that is outside the list, table or row around."""
    plain = _plain(st).replace(b"o", b"u")
    o, w = plain.find(own), plain.find(wall)
    return o + 1 if o >= 0 and (w < 0 or o < w) else 0


def _before(st: bytes, letter: bytes) -> int:
    """The place of the innermost such element's counter."""
    return _counters(st[:max(st.find(letter), 0)])


def _folded(x: bytes) -> bytes:
    """The text with its kept tags turned into marks, by a stack: its letters,
    a counter for each of some, and what is pending before the next text."""
    parts = x.split(CUT.encode())
    out, st, cnt, pend = [], b"", [], None
    for text, tag in zip(parts[::2], [*parts[1::2], None]):
        code = tag and CODES[tag.lower()]
        kind = code and code.lower()
        if text:  # what is pending first, its lines behind the marks of the open blocks
            if pend is not None:
                text = text.lstrip(SPACE)
            if kind not in MARKS:
                text = text.rstrip(SPACE)
            if text:
                out += (pend or b"", text.replace(b"\n", _line(st)) if b"\n" in text else text)
                pend = None
        if code is None:
            break
        if code != kind:
            k = _plain(st).find(b"2" if kind == b"l" else kind) + 1
            if not k:
                continue
        else:
            k = _first_of(st, *AROUND[code]) if code in AROUND else 0
        if k:
            out.append(_closed(st, st[:k], cnt))
            cnt = cnt[_counters(st[:k]):]
            st = st[k:]
        if code != kind:
            pend = _gap(st) if kind in BLOCKS else _line(st) if kind == b"l" else b"" if kind in ROWS else pend
        elif code == b"l":
            at, mark = st.replace(b"o", b"u").find(b"u"), b"* "
            if at >= 0 and st[at:at + 1] == b"o":
                j = _counters(st[:at])
                cnt[j] += 1
                mark = b"%d. " % cnt[j]
            out += (_line(st), mark)
            st, pend = b"%d" % min(len(mark), 9) + st, b""
        elif code == b"d":
            out.append(b" ")
            j = _before(st.replace(b"R", b"r"), b"r")
            if j < len(cnt):
                cnt[j] += 1
            st, pend = b"d" + st, b""
        elif code == b"r":
            j = _before(st, b"t")
            first = b"d" not in st and j < len(cnt) and cnt[j] == 0
            out += (b"\n" if first and b"2" not in _plain(st) else b"", _line(st), b"|")
            if j < len(cnt):
                cnt[j] += 1
            cnt.insert(0, 0)
            st, pend = (b"R" if first else b"r") + st, b""
        elif code in MARKS:
            again = code in _plain(st)
            out += (pend or b"", b"" if again else MARKS[code])
            st, pend = (code.upper() if again else code) + st, None
        elif code == b"q":
            cell = b"d" in st
            pend = _gap(st) + (b"" if cell else b"> ")
            st = (b"Q" if cell else b"q") + st
        else:
            pend = _gap(st)
            if code != b"u":
                cnt.insert(0, 0)
            st = code + st
    out.append(_closed(st, st, cnt))
    return b"".join(out)


def _fold_all(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
    mark = CUT.encode()
    for texts in batches:
        yield pa.array([_folded(x) if x is not None and mark in x else x for x in texts.to_pylist()], texts.type)


def _fold(x: Column) -> Column:
    # the function travels to the tasks by value: executors need PySpark alone
    cloudpickle.register_pickle_by_value(sys.modules[__name__.split(".")[0]])
    return F.arrow_udf(_fold_all, "binary")(x.cast("binary")).cast("string")


def decode_references(x: Column) -> Column:
    """Named (HTML 4) and numeric character references, in one pass; a number
    that is no character gives U+FFFD, 128 to 159 what Windows-1252 has there,
    an unknown name stays."""
    names = F.create_map(*[F.lit(v) for k, c in [*name2codepoint.items(), ("apos", 39)] for v in (k, " " if c == 160 else chr(c))])
    old = F.create_map(*[F.lit(v) for b in range(128, 160) for v in (b, bytes([b]).decode("cp1252", "ignore") or chr(b))])

    def char(n: Column) -> Column:
        wrong = (n == 0) | n.between(0xD800, 0xDFFF) | (n > 0x10FFFF)
        utf = F.decode(F.unhex(F.lpad(F.hex(F.when(wrong, 0xFFFD).otherwise(n)), 8, "0")), "UTF-32")
        return F.when(n == 160, " ").otherwise(F.coalesce(F.element_at(old, n), utf))

    def token(t: Column) -> Column:
        digits = F.regexp_extract(t, "^&#([0-9]+);$", 1)
        hexed = F.regexp_extract(t, "^&#[xX]([0-9a-fA-F]+);$", 1)
        return F.when(~t.startswith("&"), t).when(digits != "", char(digits.cast("int"))) \
            .when(hexed != "", char(F.conv(F.nullif(hexed, F.lit("")), 16, 10).cast("int"))) \
            .otherwise(F.coalesce(F.element_at(names, F.regexp_extract(t, "^&([A-Za-z0-9]+);$", 1)), t))

    return let(x, lambda v: F.when(v.contains("&"), F.array_join(F.transform(F.regexp_extract_all(v, F.lit(REFERENCE_RX), 0), token), "")).otherwise(v))


def _replaced(x: Column, pattern: str, new: str, guard: list[str]) -> Column:
    """A regex pass where one of the guard's strings, which each match holds, occurs."""
    return let(x, lambda v: F.when(any_contains(v, guard), F.regexp_replace(v, pattern, new)).otherwise(v))


def clean_markdown(html: Column, body_format: Column | None = None) -> Column:
    """D1–D6 with the body's structure; the error sentinel for NULL."""
    del body_format  # accepted and ignored (D6)
    marks = HEAD + B_ON + B_OFF + I_ON + I_OFF + CUT
    x = let(html, lambda v: F.when(any_contains(v, list(marks)), F.translate(v, marks, "")).otherwise(v))
    x = F.regexp_replace(F.regexp_replace(x, GONE_RX, ""), ATTRS_RX, "<$1>")
    x = strip_css(x)
    x = F.regexp_replace(x, HEADING_RX, "\n" + HEAD + "$1 ")
    for n in range(1, 7):
        x = F.replace(x, F.lit(f"{HEAD}{n}"), F.lit("#" * n))
    x = F.regexp_replace(F.regexp_replace(x, BREAK_RX, "\n"), OTHER_RX, "")
    x = _replaced(_replaced(x, SPACES_RX, " ", ["  ", "\t"]), EDGE_SPACE_RX, "\n", [" \n", "\n "])
    x = _fold(F.regexp_replace(F.regexp_replace(x, IMPLIED_RX, ""), KEPT_RX, CUT + "<$1>" + CUT))
    for on, off in ((B_ON, B_OFF), (I_ON, I_OFF)):
        x = _replaced(_replaced(x, rf"{on}(\s+)", f"$1{on}", [on]), rf"(\s+){off}", f"{off}$1", [off])
        x = F.replace(x, F.lit(on + off), F.lit(""))
    x = F.replace(F.replace(F.replace(F.replace(x, F.lit(B_ON), F.lit("**")), F.lit(B_OFF), F.lit("**")), F.lit(I_ON), F.lit("*")), F.lit(I_OFF), F.lit("*"))
    x = _replaced(_replaced(x, r"[ \t]+\n", "\n", [" \n", "\t\n"]), BLANKS_RX, "\n\n", ["\n\n\n"])
    return F.coalesce(py_strip(decode_references(x)), F.lit(cfg.CLEAN_ERROR))
