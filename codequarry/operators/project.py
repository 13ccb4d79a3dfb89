"""What projects and their packages are made of.

Names of files say most of it, and reading names touches no text; only
``package.json`` files are read. What a project has is a table of
(project, section, value) rows: values are made distinct per task before they
are shuffled by project *and* value, so a project that holds much of the corpus
neither lands in one task nor becomes one giant row.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from codequarry.functions.languages import display_language
from codequarry.functions.text import basename, let
from codequarry.rules.technologies import (
    BACKEND_RUNTIME,
    ENTRY_POINTS,
    MANAGERS,
    MANIFESTS,
    ROLE_DIRECTORIES,
    RUNTIMES,
    TECHNOLOGIES,
)
from codequarry.sources.corpus import PACKAGE_KIND, only_kinds, scan

_PACKAGE_TYPE = (
    "name string, scripts map<string,string>, dependencies map<string,string>, "
    "devDependencies map<string,string>, peerDependencies map<string,string>"
)
_STRICT = {
    "mode": "PERMISSIVE",
    "columnNameOfCorruptRecord": "broken",
    "allowSingleQuotes": "false",
    "allowNonNumericNumbers": "false",
}
_DEPENDENCY_MAPS = ("dependencies", "devDependencies", "peerDependencies")
# Section of a project -> category of its technologies.
_SECTIONS = {
    "databases": "database",
    "orms": "orm",
    "realtime": "realtime",
    "ai": "ai",
    "testing": "testing",
}


def packages(files: DataFrame) -> DataFrame:
    """(project, path, name, scripts, dependencies) of every readable package.json.

    Text that is no JSON, or JSON that is empty in the sense of ``null``, ``0``,
    ``false`` and ``""``, is passed over. Other values that are not an object
    count as a package with nothing in it.
    """
    text = F.regexp_replace("content", r"\A[ \t\r\n]+|[ \t\r\n]+\z", "")
    is_object = text.startswith("{")
    # Spark reads the first value and ignores what follows it, so the text is
    # judged as the only element of an array that is followed by another field.
    wrapped = F.concat(F.lit('{"value":['), text, F.lit('],"end":1}'))
    checked = F.from_json(wrapped, "value array<string>, end int, broken string", _STRICT)
    valid = let(
        checked,
        lambda c: c["broken"].isNull() & (c["end"] == 1) & (F.size(c["value"]) == 1),
    )
    nothing = text.rlike(r'\A(?:null|false|-?0(?:\.0+)?(?:[eE][+-]?\d+)?|"")\z')
    found = (
        only_kinds(scan(files), PACKAGE_KIND)
        .where(basename(F.col("path")) == "package.json")
        .where(valid & ~nothing)
    )
    parsed = F.when(is_object, F.from_json(text, _PACKAGE_TYPE, _STRICT))
    return found.select("project", "path", parsed.alias("json")).select(
        "project",
        "path",
        F.col("json.name").alias("name"),
        F.col("json.scripts").alias("scripts"),
        F.concat(
            *[
                F.coalesce(
                    F.array_distinct(F.map_keys(f"json.{m}")), F.array().cast("array<string>")
                )
                for m in _DEPENDENCY_MAPS
            ]
        ).alias("dependencies"),
    )


def package_dependencies(files: DataFrame) -> DataFrame:
    """(project, path, ord, dependency), repeats kept across the three maps."""
    return packages(files).select(
        "project", "path", F.posexplode("dependencies").alias("ord", "dependency")
    )


def _technologies(category: str, dependencies: Column) -> Column:
    """Technologies of a category named by lower-cased dependencies, in table order."""
    rules = F.array(
        *[
            F.struct(
                F.lit(technology).alias("technology"),
                F.array(*[F.lit(n.lower()) for n in names]).alias("names"),
            )
            for technology, names in TECHNOLOGIES[category].items()
        ]
    )
    return F.transform(
        F.filter(rules, lambda r: F.arrays_overlap(r["names"], dependencies)),
        lambda r: r["technology"],
    )


def _role(path: Column, start_script: Column, frontend: Column, backend: Column) -> Column:
    lowered = F.lower(path)
    role = F
    for directory, side in ROLE_DIRECTORIES:
        inside = lowered.contains(f"\\{directory}\\") | lowered.contains(f"/{directory}/")
        role = role.when(inside, side)
    has_frontend, has_backend = F.size(frontend) > 0, F.size(backend) > 0
    return (
        role.when(has_frontend & ~has_backend, "frontend")
        .when(has_backend & ~has_frontend, "backend")
        .when(has_backend & (F.coalesce(start_script, F.lit("")) != ""), "backend")
        .otherwise("unknown")
    )


def _detected(files: DataFrame) -> DataFrame:
    """Packages with a column of technologies per category and their role."""
    lowered = F.transform("dependencies", F.lower)
    found = let(
        lowered, lambda d: F.struct(*[_technologies(c, d).alias(c) for c in TECHNOLOGIES])
    )
    return packages(files).withColumn("found", found).select(
        "project",
        "path",
        "name",
        _role(
            F.col("path"),
            # Of a key written twice the last value counts.
            F.try_element_at(
                F.filter(F.map_entries("scripts"), lambda e: e["key"] == "start"), F.lit(-1)
            )["value"],
            F.col("found.frontend"),
            F.col("found.backend"),
        ).alias("role"),
        "found",
        "dependencies",
    )


def package_profiles(files: DataFrame) -> DataFrame:
    """One row per package."""
    return _detected(files).select(
        "project",
        "path",
        "name",
        "role",
        F.concat("found.frontend", "found.backend").alias("frameworks"),
        *[F.col(f"found.{category}").alias(name) for name, category in _SECTIONS.items()],
        "dependencies",
    )


def package_technologies(files: DataFrame) -> DataFrame:
    """(project, path, category, technology) of every package."""
    rows = F.concat(*[_tagged(F.lit(c), F.col(f"found.{c}")) for c in TECHNOLOGIES])
    return _detected(files).select("project", "path", F.inline(rows))


def _tagged(category: Column, technologies: Column) -> Column:
    return F.transform(
        technologies, lambda t: F.struct(category.alias("category"), t.alias("technology"))
    )


def project_technologies(files: DataFrame) -> DataFrame:
    """Distinct (project, category, technology).

    All frameworks of a frontend package count as frontend and all of a backend
    package as backend; only where the role is unknown do they keep their own.
    """

    def used_as(category: str) -> Column:
        if category in _SECTIONS.values():
            return F.lit(category)
        return F.when(F.col("role") == "unknown", category).otherwise(F.col("role"))

    rows = [_tagged(used_as(c), F.col(f"found.{c}")) for c in TECHNOLOGIES]
    return _detected(files).select("project", F.inline(F.concat(*rows))).distinct()


def project_languages(files: DataFrame) -> DataFrame:
    """Distinct (project, language)."""
    language = display_language(F.col("path"))
    return (
        scan(files)
        .select("project", language.alias("language"))
        .where(F.col("language").isNotNull())
        .distinct()
    )


def _named(value: Column, names: dict[str, list[str]]) -> Column:
    """The key whose list holds the value; null if there is none."""
    name = F
    for key, members in names.items():
        name = name.when(value.isin(*members), key)
    return name.otherwise(F.lit(None).cast("string"))


def package_managers(files: DataFrame) -> DataFrame:
    """Distinct (project, manager)."""
    manager = _named(basename(F.col("path")), MANAGERS)
    return (
        scan(files)
        .select("project", manager.alias("manager"))
        .where(F.col("manager").isNotNull())
        .distinct()
    )


def runtimes(files: DataFrame) -> DataFrame:
    """Distinct (project, runtime) shown by languages or a backend technology."""
    by_language = project_languages(files).select(
        "project", _named(F.col("language"), RUNTIMES).alias("runtime")
    )
    technology, runtime = BACKEND_RUNTIME
    by_backend = (
        project_technologies(files)
        .where((F.col("category") == "backend") & (F.col("technology") == technology))
        .select("project", F.lit(runtime).alias("runtime"))
    )
    return by_language.where("runtime is not null").unionByName(by_backend).distinct()


def entry_points(files: DataFrame) -> DataFrame:
    """(project, file) of files with the name of an entry point."""
    return (
        scan(files)
        .where(basename(F.col("path")).isin(*ENTRY_POINTS))
        .select("project", F.col("path").alias("file"))
    )


def manifests(files: DataFrame) -> DataFrame:
    """(project, file, type) of manifest files."""
    name = basename(F.col("path"))
    return (
        scan(files)
        .where(name.isin(*MANIFESTS))
        .select("project", F.col("path").alias("file"), name.alias("type"))
    )


def project_dependencies(files: DataFrame) -> DataFrame:
    """Distinct (project, dependency)."""
    return package_dependencies(files).select("project", "dependency").distinct()


def _name_rows(files: DataFrame, paths: bool) -> DataFrame:
    """(project, section, value, detail) read from the names of files alone.

    With ``paths`` those that list the files themselves, which are unique, else the others.
    """
    path, name = F.col("path"), basename(F.col("path"))

    def row(section: str, value: Column, detail: Column | None = None) -> Column:
        return F.struct(
            F.lit(section).alias("section"),
            value.alias("value"),
            (F.lit(None) if detail is None else detail).cast("string").alias("detail"),
        )

    language = display_language(path)
    rows = (
        F.array(
            row("entryPoints", F.when(name.isin(*ENTRY_POINTS), path)),
            row("manifests", F.when(name.isin(*MANIFESTS), path), name),
        )
        if paths
        else F.array(
            row("languages", language),
            row("runtimes", let(language, lambda x: _named(x, RUNTIMES))),
            row("packageManagers", _named(name, MANAGERS)),
        )
    )
    return (
        scan(files)
        .select("project", F.inline(F.filter(rows, lambda r: r["value"].isNotNull())))
        .select("project", "section", "value", "detail")
    )


def _package_rows(files: DataFrame) -> DataFrame:
    """(project, section, value, detail) read from packages."""
    technology, runtime = BACKEND_RUNTIME

    def rows(section: str, values: Column, detail: Column | None = None) -> Column:
        return F.transform(
            values,
            lambda v: F.struct(
                F.lit(section).alias("section"),
                v.alias("value"),
                (F.lit(None) if detail is None else detail).cast("string").alias("detail"),
            ),
        )

    role = F.col("role")
    frontend, backend = F.col("found.frontend"), F.col("found.backend")
    in_backend = (role != "frontend") & F.array_contains(backend, technology)
    return _detected(files).select(
        "project",
        F.inline(
            F.concat(
                rows("frameworks", frontend, F.when(role == "backend", role).otherwise("frontend")),
                rows("frameworks", backend, F.when(role == "frontend", role).otherwise("backend")),
                *[rows(s, F.col(f"found.{c}")) for s, c in _SECTIONS.items()],
                rows(
                    "runtimes",
                    F.when(in_backend, F.array(F.lit(runtime))).otherwise(
                        F.array().cast("array<string>")
                    ),
                ),
                rows("dependencies", F.col("dependencies")),
            )
        ),
    )


def project_profiles(files: DataFrame) -> DataFrame:
    """Everything known of each project: distinct (project, section, value, detail).

    Sections are those of a project profile. ``detail`` is the side a framework
    is used on and the type of a manifest. Files listed by path are unique and
    are not shuffled; the rest goes through one shuffle.
    """
    repeated = _name_rows(files, paths=False).unionByName(_package_rows(files))
    return repeated.distinct().unionByName(_name_rows(files, paths=True))


def project_summary(files: DataFrame) -> DataFrame:
    """One row per project: sorted arrays of what comes from fixed tables, and
    counts of what has no bound (dependencies, entry points, manifests)."""
    rows = project_profiles(files)
    listed = ["languages", "frameworks", *_SECTIONS, "runtimes", "packageManagers"]
    counted = ["dependencies", "entryPoints", "manifests"]

    def value_in(section: str) -> Column:
        return F.when(F.col("section") == section, F.col("value"))

    return rows.groupBy("project").agg(
        *[F.array_sort(F.collect_set(value_in(s))).alias(s) for s in listed],
        *[F.count(value_in(s)).alias(s) for s in counted],
    )


# Sections that come from fixed tables, and those without a bound, which pages hold.
_LISTED = ("languages", "frameworks", *_SECTIONS, "runtimes", "packageManagers")
_PAGED = ("dependencies", "entryPoints", "manifests")


def project_pages(files: DataFrame, entries: int = 1000) -> DataFrame:
    """Whole project profiles as nested rows: (project, page, *sections), pages from 0.

    Page 0 holds all of what comes from fixed tables; frameworks have the side they are used on.
    Dependencies, entry points and manifests (with their type) are cut into pages of `entries`
    each, so no row grows with the project. All pages of a project joined are its profile.

    Entries are numbered without bringing a project together: a hash of the value deals them to
    as many buckets as all entries fill pages, each is numbered within its bucket, and the
    bucket's offset is the sum of the counts before it. That depends on the values alone, so a
    task that runs again gives the same.
    """
    if entries < 1:
        raise ValueError("a page holds one entry at least")
    rows = project_profiles(files)
    paged = rows.where(F.col("section").isin(*_PAGED))
    buckets = max(1, -(-paged.count() // entries))
    key = ["project", "section", "bucket"]
    dealt = paged.withColumn("bucket", F.pmod(F.xxhash64("value", "detail"), F.lit(buckets)))
    order = Window.partitionBy(*key).orderBy("value", "detail")
    numbered = dealt.withColumn("number", F.row_number().over(order) - 1)
    before = Window.partitionBy("project", "section").orderBy("bucket")
    counts = dealt.groupBy(*key).agg(F.count("*").alias("n"))
    counts = counts.withColumn("offset", F.sum("n").over(before) - F.col("n")).drop("n")
    page = F.floor((F.col("offset") + F.col("number")) / entries).cast("int")
    placed = numbered.join(counts, key).withColumn("page", page)
    fixed = rows.where(F.col("section").isin(*_LISTED)).withColumn("page", F.lit(0))
    columns = ["project", "page", "section", "value", "detail"]
    together = fixed.select(*columns).unionByName(placed.select(*columns))

    def of(section: str, item: Column) -> Column:
        return F.sort_array(F.collect_set(F.when(F.col("section") == section, item)))

    value = F.col("value")
    sided = F.struct(value.alias("name"), F.col("detail").alias("side"))
    typed = F.struct(value.alias("file"), F.col("detail").alias("type"))
    items = {"frameworks": sided, "manifests": typed}
    return together.groupBy("project", "page").agg(
        *[of(s, items.get(s, value)).alias(s) for s in (*_LISTED, *_PAGED)]
    )


def profile_rows(pages: DataFrame) -> DataFrame:
    """(project, section, value, detail) of pages: the rows of `project_profiles`."""

    def rows(section: str) -> Column:
        fields = {"frameworks": ("name", "side"), "manifests": ("file", "type")}.get(section)

        def row(v: Column) -> Column:
            value, detail = (v[fields[0]], v[fields[1]]) if fields else (v, F.lit(None).cast("string"))
            return F.struct(F.lit(section).alias("section"), value.alias("value"), detail.alias("detail"))

        return F.transform(section, row)

    return pages.select("project", F.inline(F.concat(*[rows(s) for s in (*_LISTED, *_PAGED)])))
