"""Names and paths as column expressions; nothing here touches a file system."""

from pyspark.sql import Column, functions as F

from vellum import fixed

_SPLIT_NAME = r"(?s)^(\.*[^.].*)(\.[^.]*)$"
_NEEDS_NORMALISING = r"^[^/]|//|/\.{1,2}(/|$)|.+/$"


def strip(value: Column) -> Column:
    """Both ends trimmed of all Unicode whitespace, not only of spaces."""
    return F.btrim(value, F.lit(fixed.WHITESPACE))


def basename(path: Column) -> Column:
    return F.substring_index(path, "/", -1)


def parent(path: Column) -> Column:
    head = F.regexp_extract(path, r"(?s)^(.*)/[^/]*$", 1)
    return F.when((head == "") & path.startswith("/"), F.lit("/")).otherwise(head)


def ext(name: Column) -> Column:
    """The extension with its dot; leading dots do not start one."""
    return F.regexp_extract(name, _SPLIT_NAME, 2)


def stem(name: Column) -> Column:
    return F.substr(name, F.lit(1), F.length(name) - F.length(ext(name)))


def file_format(name: Column) -> Column:
    """The extension lower-cased and without its dot: what allow-lists hold."""
    return F.lower(F.substr(ext(name), F.lit(2)))


def name_key(name: Column) -> Column:
    """The key two names share when a case-insensitive disk cannot tell them apart.

    Through upper case and back, so that letters that share an upper case (as both small sigmas do) meet; `ß` is `ss`.
    """
    return F.replace(F.lower(F.upper(F.lower(name))), F.lit("ß"), F.lit("ss"))


def normalise(path: Column, base: str = "/") -> Column:
    """Absolute path without `.`, `..` or doubled slashes, resolved against `base`."""
    full = F.when(path.startswith("/"), path).otherwise(F.concat(F.lit(base + "/"), path))
    parts = F.filter(F.split(full, "/"), lambda p: ~p.isin("", "."))
    walked = F.aggregate(
        parts,
        F.expr("cast(array() as array<string>)"),
        lambda done, p: F.when(p == "..", F.slice(done, F.lit(1), F.greatest(F.size(done) - 1, F.lit(0))))
        .otherwise(F.array_append(done, p)))
    return (F.when(path.rlike(_NEEDS_NORMALISING) | (path == ""),
                   F.concat(F.lit("/"), F.array_join(walked, "/")))
            .otherwise(path))


def under(path: Column, root) -> Column:
    """Is a normalised `path` the root itself or inside it?"""
    root = F.lit(root) if isinstance(root, str) else root
    root = F.rtrim(root, F.lit("/"))
    return (path == root) | path.startswith(F.concat(root, F.lit("/")))


def confine(path: Column, root: str, what: str) -> Column:
    """struct(path, error): the normalised path, and why it is refused if it leaves `root`."""
    real = normalise(path)
    return F.struct(
        real.alias("path"),
        F.when(~under(real, root), F.lit(f"{what} must be under {root}")).alias("error"))


def relative_to(path: Column, root) -> Column:
    """`path` relative to `root`, both without `.` and `..`; null without a root or outside it."""
    if root is None:
        return F.lit(None).cast("string")
    path = normalise(path)
    prefix = F.concat(F.rtrim(normalise(F.lit(root) if isinstance(root, str) else root), F.lit("/")), F.lit("/"))
    return F.when(path.startswith(prefix), F.substr(path, F.length(prefix) + 1))


def relative_dir(path: Column, root) -> Column:
    """The folder of `path` relative to `root`; empty at the root or outside it."""
    rel = relative_to(path, root)
    return F.coalesce(F.regexp_extract(rel, r"(?s)^(.*)/[^/]*$", 1), F.lit(""))


def safe_name(name: Column) -> Column:
    """The last path element, never empty or dotted: a name cannot steer where it is written."""
    last = strip(basename(F.replace(name, F.lit("\\"), F.lit("/"))))
    return F.when(name.isNull() | last.isin("", ".", ".."), F.lit("document")).otherwise(last)


def output_folder(path: Column, output_dir, input_root=None) -> Column:
    """`<output_dir>/<relative dir>/<stem>_<ext>`, or `<name>.d` where that could not be read back."""
    path = normalise(path)
    name = basename(path)
    extension = F.substr(ext(name), F.lit(2))
    folder = (F.when((extension != "") & ~extension.contains("_"),
                     F.concat(stem(name), F.lit("_"), F.lower(extension)))
              .otherwise(F.concat(name, F.lit(".d"))))
    rel = relative_dir(path, input_root)
    out = F.lit(output_dir) if isinstance(output_dir, str) else output_dir
    return F.concat_ws("/", out, F.when(rel != "", rel), folder)


def is_sidecar(name: Column) -> Column:
    return (name == fixed.SIDECAR_NAME) | name.endswith(fixed.SIDECAR_SUFFIX)


def common_prefix(first: Column, last: Column) -> Column:
    """The leading elements two arrays share; of a group's min and max it is the whole group's."""
    same = F.zip_with(first, last, lambda a, b: a.eqNullSafe(b))
    at = F.array_position(same, F.lit(False))
    return F.when(at == 0, first).otherwise(F.slice(first, F.lit(1), F.greatest(at - 1, F.lit(0)).cast("int")))
