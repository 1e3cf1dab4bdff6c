"""String helpers: paths, ASCII case folding, byte-exact cuts, sizes and excerpts."""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def col(c) -> Column:
    return F.col(c) if isinstance(c, str) else c


def let(value: Column, body) -> Column:
    """Bind an expression to a name, so that it is evaluated once however often ``body`` uses it."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def alower(c) -> Column:
    """Lower-case A-Z only; every other character stays as it is."""
    return F.translate(col(c), _UPPER, _LOWER)


def basename(path) -> Column:
    return F.substring_index(col(path), "/", -1)


def dirname(path) -> Column:
    return F.regexp_extract(col(path), "^(.*)/[^/]*$", 1)


def stem(path) -> Column:
    """File name without its last extension; a leading dot does not start one."""
    return F.regexp_replace(basename(path), r"(?<=.)\.[^.]*$", "")


def ext_lower(path) -> Column:
    return alower(F.regexp_extract(basename(path), r"^.+\.([^.]*)$", 1))


def norm_ext(ext) -> Column:
    e = col(ext)
    return F.when(e.isin("jpeg", "jpe"), "jpg").when(e == "tif", "tiff").otherwise(e)


def ancestor_dirs(root, path) -> Column:
    """Folder names from the file's own folder up to and including the root, nearest first."""
    root_depth = F.size(F.split(col(root), "/"))
    parts = F.split(dirname(path), "/")
    return F.reverse(F.slice(parts, root_depth, F.size(parts) - root_depth + 1))


def path_under(path, folders: list[str]) -> Column:
    """The path equals, or lies inside, any of the folders; no folders means everywhere."""
    tests = []
    for f in (f.strip() for f in folders):
        if f:
            f = f.rstrip("/") or "/"
            tests.append((col(path) == f) | col(path).startswith(f if f == "/" else f + "/"))
    return reduce(lambda a, b: a | b, tests) if tests else F.lit(True)


def utf8_len(c) -> Column:
    return F.char_length(col(c))


def has_cjk(c) -> Column:
    """Any character whose UTF-8 lead byte is E3..ED (U+3000..U+DFFF)."""
    return col(c).rlike("[\\x{3000}-\\x{D7FF}]")


def bound(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body`` of a value that is computed once, however often and in whatever lambda the body names it."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def utf8_cut(c, max_bytes: int) -> Column:
    """The longest prefix of at most ``max_bytes`` bytes that ends on a character boundary."""
    raw = F.encode(col(c), "UTF-8")
    out = None
    for back in range(3, -1, -1):
        cut = max_bytes - back
        piece = F.decode(F.substring(raw, 1, cut), "UTF-8")
        lead = ~F.hex(F.substring(raw, cut + 1, 1)).between("80", "BF")
        out = piece if out is None else F.when(lead, piece).otherwise(out)
    return F.when(F.octet_length(col(c)) <= max_bytes, col(c)).otherwise(out)


def clean_value(c, max_bytes: int) -> Column:
    """Line breaks and tabs to spaces, trimmed, cut to a byte limit."""
    return utf8_cut(F.trim(F.translate(col(c), "\n\r\t", "   ")), max_bytes)


def human_size(n) -> Column:
    v = col(n).cast("double")
    steps = [(1024.0 ** i, u) for i, u in enumerate(["B", "KB", "MB", "GB", "TB"])]
    out = F.format_string("%d B", col(n).cast("bigint"))
    for scale, unit in steps[1:]:
        x = v / F.lit(scale)
        text = F.when(x < 10, F.format_string("%.1f " + unit, F.bround(x, 1))).otherwise(F.format_string("%.0f " + unit, F.bround(x, 0)))
        out = F.when(v >= scale, text).otherwise(out)
    return out


def duration_text(seconds) -> Column:
    s = col(seconds).cast("double")
    t = F.floor(s + 0.5).cast("bigint")
    minutes = F.floor(t / 60)
    return (F.when(s < 1, "< 1 s")
            .when(t < 60, F.format_string("%d s", t))
            .when(t < 3600, F.format_string("%d min %02d s", minutes, t % 60))
            .otherwise(F.format_string("%d h %02d min", F.floor(t / 3600), minutes % 60)))


def looks_like_copy(path) -> Column:
    """Copy-like file name endings or backup-like folders. The two patterns."""
    name_re = r"(?i)(\(\d+\)|[ _-]copy( \d+)?|副本.*)$"
    dir_re = r"(?i)(^|/)(backups?|copy|copies|duplicates?|old|备份|副本)(/|$)"
    return stem(path).rlike(name_re) | dirname(path).rlike(dir_re)


def screenshot_name(name) -> Column:
    """The words that mark a screenshot in four languages."""
    words = ["screenshot", "screen shot", "screencap", "截屏", "截图", "スクリーンショット", "스크린샷"]
    return reduce(lambda a, b: a | b, [F.contains(alower(name), F.lit(w)) for w in words])


def is_text_image(path) -> Column:
    name = alower(basename(path))
    words = ["screenshot", "screen shot", "截图", "截屏"]
    return ext_lower(path).isin("png", "webp", "gif") | reduce(lambda a, b: a | b, [F.contains(name, F.lit(w)) for w in words])


def excerpt(text, term, around: int = 24) -> Column:
    """The first hit of ``term`` with context on both sides; cut ends are marked."""
    w = term if isinstance(term, Column) else F.lit(term)
    return excerpt_at(text, F.position(w, alower(text)), F.length(w), around)


def excerpt_at(text, pos: Column, length: Column, around: int = 24) -> Column:
    """The stretch at ``pos`` (from 1) with context on both sides."""
    t = col(text)
    start = F.greatest(pos - around, F.lit(1))
    stop = F.least(pos + length + around, F.length(t) + 1)
    body = F.trim(F.translate(F.substring(t, start, stop - start), "\n", " "))
    return F.when(pos > 0, F.concat(F.when(start > 1, "…").otherwise(""), body,
                                    F.when(stop <= F.length(t), "…").otherwise("")))


def meta_line(lines, term) -> Column:
    """The metadata line that holds the first hit, at most 80 bytes."""
    w = term if isinstance(term, Column) else F.lit(term)
    line = F.get(F.filter(F.split(col(lines), "\n"), lambda x: F.contains(x, w)), F.lit(0))
    return F.when(F.octet_length(line) > 80, F.concat(utf8_cut(line, 80), F.lit("…"))).otherwise(line)


def placeholder_text(text, file_stem) -> Column:
    """Camera defaults, file names and other text that describes nothing. The pattern."""
    t = alower(F.trim(col(text)))
    junk = (r"^(olympus digital camera|sony dsc|digital camera|minolta digital camera|kodak.*|samsung.*|lg electronics.*|"
            r"default|untitled.*|image|photo|picture|screenshot|dcim.*|created with .*|made with .*|ilce-?\w*|nikon.*|canon.*|"
            r"(img|dsc|dscn|dscf|pxl|p|mvimg|vid)[_-]?\d+.*|\d+|[-_. ]+)$")
    return (F.octet_length(t) < 3) | (t == alower(file_stem)) | t.rlike(junk)


def text_covers(have, ours) -> Column:
    """``have`` contains ``ours``, or at least every content word of it."""
    h, o = alower(have), alower(ours)
    # fixed values: words without content
    stop = ["shows", "a", "an", "the", "of", "and", "with", "in", "on", "at", "photo"]
    words = F.filter(F.split(o, r"[^a-z0-9\x{80}-\x{10FFFF}]+"), lambda w: (F.octet_length(w) > 1) & ~w.isin(stop))
    return F.contains(h, o) | ((F.size(words) > 0) & F.forall(words, lambda w: F.contains(h, w)))


def first_json_object(text) -> Column:
    """The first balanced ``{...}`` after removing thinking blocks; '' when there is none.

    Quoted strings are blanked (same length) so that one pass over the braces gives the nesting depth at each of them.
    """
    s = F.regexp_replace(col(text), r"(?s)<think>.*?(</think>|$)", "")
    body = F.substring(s, F.locate("{", s), F.length(s))
    # only braces outside strings matter: keep them, drop everything else but remember the text before each one
    tokens = F.regexp_extract_all(body, F.lit(r'(?s)("(?:[^"\\]|\\.)*"|[{}]|[^{}"]+|")'), F.lit(1))
    start = F.struct(F.lit(0).alias("depth"), F.lit("").alias("out"), F.lit(False).alias("done"))

    def step(acc, t):
        depth = acc["depth"] + F.when(t == "{", 1).when(t == "}", -1).otherwise(0)
        return F.when(acc["done"], acc).otherwise(
            F.struct(depth.alias("depth"), F.concat(acc["out"], t).alias("out"), ((t == "}") & (depth == 0)).alias("done")))

    folded = F.aggregate(tokens, start, step)
    return F.when(F.locate("{", s) > 0, F.when(folded["done"], folded["out"]).otherwise("")).otherwise("")
