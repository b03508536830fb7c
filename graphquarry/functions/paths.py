"""What a file's path and content say, as expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Names of files that say nothing, and kinds of files that are read.
GENERIC_FILES = ("index.ts", "index.tsx", "page.tsx", "page.ts", "route.ts", "route.tsx", "layout.tsx", "types.ts", "utils.ts", "config.ts", "main.ts", "app.tsx")
ANALYSED = r"\.(ts|tsx|prisma)$"


def _slashed(path: Column) -> Column:
    return F.replace(path, F.lit("\\"), F.lit("/"))


def normalise_path(path: Column, root: Column) -> Column:
    """A path relative to a root, with forward slashes."""
    p, r = _slashed(path), F.regexp_replace(_slashed(root), "/$", "")
    return F.regexp_replace(F.when(F.startswith(p, r), F.substring(p, F.length(r) + 1, F.length(p))).otherwise(p), "^/", "")


def route_path(file: Column) -> Column:
    """The url path that a route file serves: what follows app/, without the file's name and groups in brackets."""
    inner = F.regexp_replace(file, r"^(?s).*?(?:^|/)app/", "")
    inner = F.regexp_replace(F.regexp_replace(inner, r"/route\.tsx?$", ""), r"/\([^)]+\)", "")
    return F.regexp_replace(F.concat(F.lit("/"), inner), "/+", "/")


def is_route_file(file: Column) -> Column:
    return file.rlike(r"(^|/)app/(.*/)?route\.tsx?$")


def is_test_file(file: Column) -> Column:
    return file.rlike(r"\.(test|spec)\.tsx?$")


def is_component(file: Column, name: Column) -> Column:
    """Whether a function of this name in this file is a component: a capital first, in a .tsx file."""
    return F.endswith(file, F.lit(".tsx")) & F.substring_index(name, ".", -1).rlike("^[A-Z]")


def is_analysed(file: Column) -> Column:
    return file.rlike(ANALYSED)


def root_place(file: Column, name: Column) -> Column:
    """The place that a function belongs to: its file and its outermost name."""
    return F.concat(file, F.lit("#"), F.substring_index(name, ".", 1))


def content_hash(content: Column) -> Column:
    """16 characters of the content's SHA-1."""
    return F.substring(F.base64(F.unhex(F.sha1(content))), 1, 16)


def joined_path(folder: Column, relative: Column) -> Column:
    """A relative path from a folder, without . and .. parts; those that lead out of the root stay."""
    parts = F.filter(F.split(F.concat_ws("/", folder, relative), "/"), lambda p: ~p.isin("", "."))
    up = lambda a: (F.size(a) > 0) & (F.element_at(a, -1) != "..")
    return F.array_join(F.aggregate(parts, F.array().cast("array<string>"), lambda a, p: F.when((p == "..") & up(a), F.slice(a, 1, F.size(a) - 1)).otherwise(F.concat(a, F.array(p)))), "/")


def import_target(from_file: Column, specifier: Column) -> Column:
    """Where a relative import points, without extension; null for others."""
    folder = F.when(F.contains(from_file, F.lit("/")), F.regexp_replace(from_file, "/[^/]*$", "")).otherwise(F.lit(""))
    return F.when(F.startswith(specifier, F.lit(".")), F.regexp_replace(joined_path(folder, specifier), r"\.(ts|tsx|js|jsx)$", ""))


def without_comment(line: Column) -> Column:
    """A line up to the first // outside double quotes."""
    return F.regexp_extract(line, r'^((?:[^"/]|"[^"]*(?:"|$)|/(?!/))*)', 1)


def is_user_text(value: Column) -> Column:
    """Whether a string reads like a message to people rather than a key, a path or a class list."""
    text = F.trim(F.regexp_replace(value, r"^\s+|\s+$", ""))
    words = F.split(text, r"\s+")
    shaped = F.size(F.filter(words, lambda w: w.rlike(r"^[a-zA-Z][a-zA-Z'\u2019.,!?-]*$")))
    letters = F.length(F.regexp_replace(text, "[^a-zA-Z]", ""))
    good = F.length(text).between(8, 400) & text.rlike(r"\s") & ~text.rlike(r"[/{}<>|=_$\\]") & ~text.rlike(r"^(https?:|data:|\.)")
    return F.coalesce(good & (letters >= 0.6 * F.length(text)) & (shaped >= 2) & (shaped >= 0.7 * F.size(words)), F.lit(False))


def names_file(task: Column, file: Column) -> Column:
    """Whether a task's text names a file: by its path, or by a name of its own that is long and not a common one."""
    said, wanted = F.lower(_slashed(task)), F.lower(_slashed(file))
    base = F.substring_index(wanted, "/", -1)
    return (wanted != "") & (F.contains(said, wanted) | ((F.length(base) >= 6) & ~base.isin(*GENERIC_FILES) & F.contains(said, base)))


def path_terms(file: Column, terms: Column) -> Column:
    """Terms (four of them at most) that begin like a part of a path, or that a part begins like."""
    parts = F.filter(F.split(F.lower(file), r"[/\\._-]+"), lambda s: F.length(s) >= 4)
    like = lambda t: (F.length(t) >= 4) & F.exists(parts, lambda s: F.startswith(s, F.lower(t)) | F.startswith(F.lower(t), s))
    return F.slice(F.array_distinct(F.filter(terms, like)), 1, 4)


def replaced_once(content: Column, old: Column, new: Column) -> Column:
    """`content` with its only occurrence of `old` replaced; null if there is none or more than one."""
    first = F.instr(content, old)
    rest = F.substring(content, first + 1, F.length(content))
    once = (F.length(old) > 0) & (first > 0) & (F.instr(rest, old) == 0)
    return F.when(once, F.concat(F.substring(content, F.lit(1), first - 1), new, F.substring(content, first + F.length(old), F.length(content))))
