"""Which language a file is written in, by its extension."""

from __future__ import annotations

from itertools import chain

from pyspark.sql import Column
from pyspark.sql import functions as F

from codequarry.functions.text import extension

# --- fixed values: extension -> (language key, display name) -----------------
LANGUAGES = {
    ".js": ("javascript", "JavaScript"),
    ".mjs": ("javascript", "JavaScript"),
    ".cjs": ("javascript", "JavaScript"),
    ".jsx": ("javascript", "JavaScript"),
    ".ts": ("typescript", "TypeScript"),
    ".tsx": ("typescript", "TypeScript"),
    ".py": ("python", "Python"),
    ".java": ("java", "Java"),
    ".cs": ("csharp", "CSharp"),
    ".go": ("go", "Go"),
    ".php": ("php", "PHP"),
    ".rb": ("ruby", "Ruby"),
    ".rs": ("rust", "Rust"),
    ".kt": ("kotlin", "Kotlin"),
    ".kts": ("kotlin", "Kotlin"),
    ".swift": ("swift", "Swift"),
    ".dart": ("dart", "Dart"),
    ".scala": ("scala", "Scala"),
    ".sc": ("scala", "Scala"),
    ".ex": ("elixir", "Elixir"),
    ".exs": ("elixir", "Elixir"),
}
# Files of these extensions have facts and flows but no interfaces.
WITHOUT_INTERFACES = (".jsx",)
# -----------------------------------------------------------------------------


def _lookup(path: Column, names: dict[str, str]) -> Column:
    table = F.create_map(*[F.lit(x) for x in chain(*names.items())])
    return F.try_element_at(table, F.lower(extension(path)))


def flow_language(path: Column) -> Column:
    """Language for functions, imports, database and API calls, and flows."""
    return _lookup(path, {ext: key for ext, (key, _) in LANGUAGES.items()})


def interface_language(path: Column) -> Column:
    """Language for interface discovery; null for the extensions left out."""
    return _lookup(
        path, {ext: key for ext, (key, _) in LANGUAGES.items() if ext not in WITHOUT_INTERFACES}
    )


def display_language(path: Column) -> Column:
    """Language name as shown in a project profile."""
    return _lookup(path, {ext: name for ext, (_, name) in LANGUAGES.items()})
