"""Text, version, URL and time expressions."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F


def once(value: Column, read: Callable[[Column], Column]) -> Column:
    """read(value), with the value worked out once a row, however often it is read."""
    return F.get(F.transform(F.array(value), read), F.lit(0))


def comparable_version(version: Column) -> Column:
    """A version without white space around it and without the v before its number; a lone v is empty."""
    cut = F.trim(version)
    return F.when(F.lower(cut) == "v", "").otherwise(F.regexp_replace(cut, r"^[vV](?=[0-9])", ""))


def fix_kind(version: Column) -> Column:
    """recorded, unrecorded, or not_comparable for a range rather than a version."""
    cut = F.trim(F.coalesce(version, F.lit("")))
    return F.when(cut == "", "unrecorded").when(cut.rlike(r"[<>=!~^*,&\[\](){}| \t]"), "not_comparable").otherwise("recorded")


def project_name(name: Column) -> Column:
    """A project's normalised name; null if it isn't one."""
    cut = F.trim(name)
    return F.when(cut.rlike(r"^(?i)([A-Z0-9]|[A-Z0-9][A-Z0-9._-]*[A-Z0-9])$"), F.lower(F.regexp_replace(cut, r"[-_.]+", "-")))


def project_label(key: Column) -> Column:
    return F.regexp_replace(F.lower(key), "[^a-z0-9]", "")


def package_url(kind: str, name: Column) -> Column:
    return F.concat(F.lit(f"pkg:{kind}/"), name)


def purl_parts(purl: Column) -> Column:
    """type, name and version of a package URL; all null if it can't be asked about."""
    bare = F.regexp_replace(F.trim(purl), r"[#?].*$", "")
    path = F.regexp_replace(bare, r"(?i)^pkg:/*", "")
    kind = F.lower(F.substring_index(path, "/", 1))
    rest = F.regexp_replace(path, r"^[^/]*/", "")
    decoded = lambda c: F.try_url_decode(F.replace(c, F.lit("+"), F.lit("%2B")))
    name = decoded(F.substring_index(rest, "@", 1))
    version = F.when(F.instr(rest, "@") > 0, decoded(F.substring_index(rest, "@", -1)))
    good = bare.rlike(r"(?i)^pkg:/*[a-z0-9.+-]+/[^/@]+(@[^/@]+)?$") & ~F.coalesce(name, F.lit("/")).rlike(r"[/\x00-\x1F\x7F]") & ~F.coalesce(version, F.lit("")).rlike(r"[\x00-\x1F\x7F]")
    return F.struct(F.when(good, kind).alias("type"), F.when(good, name).alias("name"), F.when(good, version).alias("version"))


def repository(url: Column, host: str = "github.com") -> Column:
    """A repository's URL in one form: https, the host, owner and repository in lower case; null for other URLs."""
    cut = F.lower(F.trim(url))
    own = host.replace(".", r"\.")
    path = F.regexp_replace(F.regexp_replace(cut, rf"^https?://(www\.)?{own}/+", ""), r"[?#].*$", "")

    def named(parts: Column) -> Column:
        name = F.regexp_replace(F.get(parts, F.lit(1)), r"\.git$", "")
        tail = F.get(parts, F.lit(2))
        good = (F.size(parts) >= 2) & (tail.isNull() | tail.isin("tree", "blob")) & (name != "")
        return F.when(good, F.concat(F.lit(f"https://{host}/"), F.get(parts, F.lit(0)), F.lit("/"), name))

    return F.when(cut.rlike(rf"^https?://(www\.)?{own}/"), once(F.filter(F.split(path, "/"), lambda x: x != ""), named))


#: Labels of links to a repository in the order that one is chosen, and labels of issue trackers.
REPOSITORY_LABELS = ("Source", "Source Code", "Repository", "Code", "GitHub")
ISSUE_LABELS = ("Issues", "Issue Tracker", "Bug Tracker", "Tracker")


def chosen_repository(urls: Column) -> Column:
    """The repository that a map of labelled links names: by label, else the home page, else an issue tracker's."""

    def chosen(labelled: Column) -> Column:
        of = lambda name: labelled[F.lit("".join(c for c in name.lower() if c.isalnum()))]
        tracker = lambda name: repository(F.regexp_replace(of(name), r"/issues/*$", ""))
        return F.coalesce(*[repository(of(n)) for n in REPOSITORY_LABELS], repository(of("Homepage")), *[tracker(n) for n in ISSUE_LABELS])

    return once(F.transform_keys(urls, lambda k, v: project_label(k)), chosen)


def scheme_of(identifier: Column) -> Column:
    return F.lower(F.substring_index(identifier, "-", 1))


# Fixed value: what follows a text that was cut.
SHORTENED = "[shortened by this collector]"


def safe_detail(text: Column, most: int = 1024, mark: str = SHORTENED) -> Column:
    """Text without control characters; of a longer one the first `most` characters, a space and the mark."""
    plain = F.regexp_replace(text, r"[\x00-\x1F\x7F\x{D800}-\x{DFFF}]", " ")
    return F.when(F.length(plain) <= most, plain).otherwise(F.concat(F.left(plain, F.lit(most)), F.lit(f" {mark}")))


def iso(at: Column) -> Column:
    """An instant as text in ISO 8601, UTC, with a fraction only where there is one."""
    fraction = F.date_format(at, "SSSSSS")
    return F.concat(F.date_format(at, "yyyy-MM-dd'T'HH:mm:ss"), F.when(fraction == "000000", "").otherwise(F.concat(F.lit("."), fraction)), F.lit("+00:00"))


def finding_key(table: str, package: Column, facts: list[tuple[str, Column]], if_set: list[tuple[str, Column]] = []) -> Column:  # noqa: B006
    """table:package:digest, the digest over each fact's name and value with their lengths; facts of `if_set` count only where they aren't null."""
    fact = lambda name, value: F.concat(F.lit(f"{len(name)}:{name}="), F.length(value).cast("string"), F.lit(":"), value)
    packed = F.concat(*[fact(name, F.coalesce(value, F.lit(""))) for name, value in facts], *[F.coalesce(fact(name, value), F.lit("")) for name, value in if_set])
    return F.concat(F.lit(f"{table}:"), package.cast("string"), F.lit(":"), F.substring(F.sha2(packed, 256), 1, 16))


def window_key(collector: Column, index: Column) -> Column:
    return F.sha2(F.concat(collector, F.lit(":"), index.cast("string")), 256)


def instant(text: Column) -> Column:
    """An ISO instant that states its zone, else null."""
    cut = F.trim(text)
    return F.when(cut.rlike(r"^\d{4}-\d{2}-\d{2}[T ]\d{2}:\d{2}(:\d{2}(\.\d+)?)?\s*(Z|z|[+-]\d{2}:?\d{2})$"), F.try_to_timestamp(cut))


def span(seconds: Column) -> Column:
    """A span in its largest whole unit: days, hours or minutes."""
    unit = lambda n, name: F.concat(n.cast("string"), F.lit(f" {name}"), F.when(n == 1, "").otherwise("s"))
    whole = lambda size: F.floor(seconds / size)
    return F.when(seconds >= 86400, unit(whole(86400), "day")).when(seconds >= 3600, unit(whole(3600), "hour")).otherwise(unit(whole(60), "minute"))


def index_path(name: Column, width: int = 3) -> Column:
    """Where an index keeps a name: its first letters or digits as folders, padded, then the name."""
    plain = F.rpad(F.regexp_replace(F.lower(name), "[^a-z0-9]", ""), width, "z")
    return F.concat(*[x for i in range(width) for x in (F.substring(plain, i + 1, 1), F.lit("/"))], F.lower(name))


def recipe_version(body: Column) -> Column:
    """A recipe's version: what its template sets, else the plain value under `package:`; null if neither stands there."""
    plain = F.regexp_replace(body, r"(?m)(^|\s)#.*$", "")
    quote = "[\"']"
    template = F.regexp_extract(plain, rf"set\s+version\s*=\s*{quote}([^\"']+){quote}", 1)
    section = F.regexp_extract(plain, r"(?m)^package:[ \t]*\r?\n(?:(?:[ \t]+[^\r\n]*|[ \t]*)\r?\n)*?[ \t]+version:[ \t]*([^\r\n]*)", 1)
    cut = F.regexp_replace(F.trim(section), rf"^{quote}|{quote}$", "")
    return F.when(template != "", template).when((cut != "") & ~cut.rlike(r"\{\{|\$\{\{|<\{"), cut)


def build_number(body: Column) -> Column:
    return F.regexp_extract(F.regexp_replace(body, r"(?m)(^|\s)#.*$", ""), r"(?m)^build:[ \t]*\r?\n(?:(?:[ \t]+[^\r\n]*|[ \t]*)\r?\n)*?[ \t]+number:[ \t]*([0-9]+)[ \t]*$", 1).try_cast("int")


def usage_score(signals: list[tuple[Column, int]], cap: int = 100) -> Column:
    """1 to 100 from weighted signals; null if one is missing, or if no signal has a weight."""
    total = sum((F.lit(w) * s for s, w in signals), F.lit(0))
    most = cap * sum(w for _, w in signals)
    if not most:
        return F.lit(None).cast("int")
    return F.when(total.isNotNull(), F.lit(1) + F.floor(F.least(total, F.lit(most)) * (cap - 1) / most)).cast("int")


def share(n: Column, whole: Column) -> Column:
    """n in the whole as a percentage with one decimal; 0 where the whole is empty."""
    return F.when(whole == 0, F.lit(0.0)).otherwise(F.round(F.lit(100.0) * n / whole, 1))
