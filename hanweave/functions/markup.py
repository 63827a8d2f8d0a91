"""Character references, and charset labels in web pages."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from hanweave.functions.binding import bind

#: Extensions whose charset labels are rewritten.
LABELLED = ("htm", "html", "shtm", "shtml", "asp", "aspx", "php", "css")


def _references(text: Column, number) -> Column:
    def one(c: Column) -> Column:
        code = F.ascii(c)
        plain = ((code >= 32) & (code <= 126)) | code.isin(10, 13)
        named = F.when(c == "&", "&amp;").when(c == "<", "&lt;").when(c == ">", "&gt;")
        return named.when(plain, c).otherwise(number(code))

    # runs of plain characters pass as one token
    tokens = F.regexp_extract_all(text, F.lit(r"(?s)([ -%'-;=?-~\n\r]+|.)"), F.lit(1))
    return F.array_join(F.transform(tokens, lambda t: F.when(F.length(t) > 1, t).otherwise(one(t))), "")


def decimal_references(text: Column) -> Column:
    """``&#N;`` for what isn't printable ASCII, CR or LF; named ones for ``& < >``."""
    return _references(text, lambda code: F.concat(F.lit("&#"), code.cast("string"), F.lit(";")))


def hex_references(text: Column) -> Column:
    return _references(text, lambda code: F.concat(F.lit("&#x"), F.hex(code), F.lit(";")))


#: Stands for an ampersand while other references are decoded; a noncharacter, which no text should hold.
_HELD = "\ufdd0"


def _numbers_decoded(text: Column) -> Column:
    def one(t: Column) -> Column:
        body = F.substr(t, F.lit(3), F.length(t) - 3)
        hexa = F.when(F.lower(F.substring(body, 1, 1)) == "x", F.substr(body, F.lit(2))).otherwise(F.conv(body, 10, 16))
        valid = F.conv(hexa, 16, 10).cast("long") <= 0x10FFFF
        return F.when(~F.startswith(t, F.lit("&#")), t).when(valid, F.decode(F.unhex(F.lpad(hexa, 8, "0")), "UTF-32")).otherwise(t)

    tokens = F.regexp_extract_all(text, F.lit(r"(?s)(&#(?:[0-9]{1,7}|[xX][0-9A-Fa-f]{1,6});|[^&]+|&)"), F.lit(1))
    return F.array_join(F.transform(tokens, one), "")


def decoded_references(text: Column) -> Column:
    """The inverse of both; what is no reference stays, and nothing is decoded twice."""

    def whole(t: Column) -> Column:
        # named ones first, so that numbers can't make them
        named = t
        for name, sign in (("&amp;", _HELD), ("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"')):
            named = F.replace(named, F.lit(name), F.lit(sign))
        numbers = bind(named, lambda n: F.when(F.contains(n, F.lit("&#")), _numbers_decoded(n)).otherwise(n))
        return F.replace(numbers, F.lit(_HELD), F.lit("&"))

    def either(t: Column) -> Column:
        apart = F.array_join(F.transform(F.split(t, _HELD, -1), whole), _HELD)
        return F.when(~F.contains(t, F.lit("&")), t).when(F.contains(t, F.lit(_HELD)), apart).otherwise(whole(t))

    return bind(text, either)


#: Where charset labels stand in pages: expression, then replacement.  Fixed values.
LABELS = {
    "html5": (r'(?i)<meta(\s+.*?)charset="(.*?)"(.*?)>', '<meta$1charset="{}"$3>'),
    "html4": (r'(?i)<meta\s+(.*?)content="(.*?)charset=(.*?)"(.*?)>', '<meta $1content="$2charset={}"$4>'),
    "php": (r'(?i)header\("Content-Type:text/html;\s*charset=(.*?)"\);', 'header("Content-Type:text/html; charset={}");'),
    "css": (r'(?i)@charset "(.*?)"', '@charset "{}"'),
}


def labelled(text: Column, kind: str, name: str) -> Column:
    pattern, replacement = LABELS[kind]
    return F.regexp_replace(text, pattern, replacement.format(name))


def has_label_rule(ext: Column, labels: Column) -> Column:
    """Whether an extension is in a settings document's list of labelled ones (with dots, lower case)."""
    return F.array_contains(labels, F.concat(F.lit("."), ext))


def extension(name: Column) -> Column:
    """The lower-case extension of a path or URL, without the dot; empty if it has none."""
    return F.lower(F.regexp_extract(name, r"\.([A-Za-z0-9]+)(?:[?#][^/]*)?$", 1))


def relabelled(text: Column, ext: Column, name: str) -> Column:
    """Charset labels for the target's web name, by the file's extension."""
    html = labelled(labelled(text, "html5", name), "html4", name)
    page = ext.isin("htm", "html", "shtm", "shtml", "asp", "aspx")
    return F.when(page, html).when(ext == "php", labelled(html, "php", name)).when(ext == "css", labelled(text, "css", name)).otherwise(text)
