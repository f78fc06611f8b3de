"""Options: defaults, a YAML file, the command line; and checks of how they fit together."""

from __future__ import annotations

from collections.abc import Iterable
from dataclasses import dataclass, field, fields, replace
from pathlib import Path

from weftgraph.sinks.documents import PALETTES

CONFIG_NAME, LIBRARY_SUFFIX = ".weftgraph.yml", ".agda-lib"
FORMATS, JSON_MODES = ("dot", "json"), ("packed", "expanded")
COLOUR_KEYS = ("color-defined", "color-postulate", "color-hole", "color-failed")


@dataclass(frozen=True)
class Options:
    out_dir: str | None = None
    format: str = "dot"
    json_mode: str = "packed"
    theme: str = "default"
    color_defined: str | None = None
    color_postulate: str | None = None
    color_hole: str | None = None
    color_failed: str | None = None
    exclude: tuple[str, ...] = ()
    term_scope: tuple[str, ...] = ()
    no_externals: bool = False
    lazy: bool = False
    gzip: bool = False
    keep_going: bool = False
    lenient_imports: bool = False
    resolve_deps: bool = False
    skip_agda: bool = False
    incremental: bool = False
    cache_dir: str | None = None
    quiet: bool = False
    packed_analytical: bool = False
    with_terms: bool = False
    with_type_terms: bool = False
    with_signatures: bool = False
    normalise_signatures: bool = False
    signature_implicits: bool = False
    with_term_hashes: bool = False
    min_term_depth: int = 3

    def palette(self) -> dict[str, str]:
        """Fill colours by state: the theme's, and single ones over it."""
        own = dict(zip("DPHF", (self.color_defined, self.color_postulate, self.color_hole, self.color_failed)))
        return {s: own[s] or c for s, c in zip("DPHF", PALETTES[self.theme])}

    def lazy_tree(self) -> bool:
        return self.lazy and self.json_mode == "packed"


KINDS = {f.name.replace("_", "-"): "list" if "tuple" in f.type else "flag" if f.type == "bool" else "whole" if f.type == "int" else "text" for f in fields(Options)}
CHOICES = {"format": FORMATS, "json-mode": JSON_MODES, "theme": tuple(PALETTES)}


@dataclass
class Finding:
    severity: str  # error, warning or note
    key: str
    message: str
    hint: str | None = None


@dataclass
class Report:
    findings: list[Finding] = field(default_factory=list)

    def sorted(self) -> list[Finding]:
        return sorted(self.findings, key=lambda f: ("error", "warning", "note").index(f.severity))

    def counts(self) -> tuple[int, int]:
        return sum(f.severity == "error" for f in self.findings), sum(f.severity == "warning" for f in self.findings)

    def exit_code(self, strict: bool = False) -> int:
        errors, warnings = self.counts()
        return int(errors > 0 or strict and warnings > 0)


def edit_distance(a: str, b: str) -> int:
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        before, row[0] = row[0], i
        for j, y in enumerate(b, 1):
            before, row[j] = row[j], min(row[j] + 1, row[j - 1] + 1, before + (x != y))
    return row[-1]


def nearest(key: str, known: Iterable[str]) -> str | None:
    budget = max(1, min(4, len(key) // 3))
    return min(((d, k) for k in known if (d := edit_distance(key, k)) <= budget), default=(0, None))[1]


def is_colour(value: object) -> bool:
    return isinstance(value, str) and len(value) == 7 and value[0] == "#" and all(c in "0123456789abcdefABCDEF" for c in value[1:])


def check_value(key: str, value: object) -> list[Finding]:
    kind = KINDS[key]
    if value is None:
        return [Finding("note", key, "has no value and is ignored")]
    good = {"flag": isinstance(value, bool), "text": isinstance(value, str), "whole": isinstance(value, int) and not isinstance(value, bool), "list": isinstance(value, list) and all(isinstance(x, str) for x in value)}[kind]
    if not good:
        return [Finding("error", key, f"should be a {kind}, not {value!r}")]
    if key in CHOICES and value not in CHOICES[key]:
        return [Finding("error", key, f"unknown value {value!r}", f"one of {', '.join(CHOICES[key])}")]
    if key in COLOUR_KEYS and not is_colour(value):
        return [Finding("error", key, f"{value!r} is not a colour", "write it as #RRGGBB")]
    if key == "min-term-depth" and value < 1:
        return [Finding("error", key, "must be 1 or more")]
    if key in ("exclude", "term-scope") and "" in value:
        return [Finding("error", key, "has an empty module prefix")]
    return []


@dataclass(frozen=True)
class Need:
    """What an option needs of others: every setting in all, or one of any. Without that it is void, or refused."""

    key: str
    all: tuple[tuple[str, object], ...] = ()
    any: tuple[tuple[str, object], ...] = ()
    refused: bool = False

    def lacks(self, value_of) -> str:
        """The settings that are missing, as text; value_of gives an option's value."""
        missing = [say(k, v) for k, v in self.all if value_of(k) != v]
        if self.any and all(value_of(k) != v for k, v in self.any):
            missing.append(" or ".join(say(k, v) for k, v in self.any))
        return ", ".join(missing)


def say(key: str, value: object) -> str:
    return f"{key} on" if value is True else f"{key} off" if value is False else f"{key} {value}"


JSON, PACKED, EXPANDED = ("format", "json"), ("json-mode", "packed"), ("json-mode", "expanded")
CHECKED, WHOLE = ("skip-agda", False), ("incremental", False)
NEEDS = [
    Need("json-mode", (JSON,)),
    Need("lazy", (JSON, PACKED)),
    Need("gzip", (JSON, ("lazy", True))),
    Need("packed-analytical", (JSON, PACKED)),
    Need("with-terms", (JSON, EXPANDED, WHOLE, CHECKED), refused=True),
    Need("with-type-terms", (JSON, EXPANDED, WHOLE, CHECKED), refused=True),
    Need("term-scope", (("with-terms", True),)),
    Need("with-signatures", (JSON, CHECKED), (EXPANDED, ("packed-analytical", True))),
    Need("normalise-signatures", (("with-signatures", True),)),
    Need("signature-implicits", (("with-signatures", True),)),
    Need("with-term-hashes", (JSON, CHECKED), (EXPANDED, ("packed-analytical", True))),
    Need("min-term-depth", (("with-term-hashes", True),)),
    Need("incremental", (("keep-going", False),)),
    Need("cache-dir", (("incremental", True),)),
    Need("keep-going", (CHECKED,)),
    Need("lenient-imports", (CHECKED,)),
]


def _other_format(name: str | None, format: str) -> str | None:
    """The format that a name's ending says, if it isn't the one chosen."""
    ending = Path(name or "").suffix[1:]
    return ending if ending in FORMATS and ending != format else None


def doctor(config: object, base: Path | None = None) -> Report:
    """Findings about a parsed config file: unknown keys, wrong values, settings without effect, paths that don't exist."""
    report = Report()
    if config is None:
        return report
    if not isinstance(config, dict):
        report.findings.append(Finding("error", "", "the file is not a mapping"))
        return report
    for key, value in config.items():
        if key not in KINDS:
            near = nearest(str(key), KINDS)
            report.findings.append(Finding("error", str(key), "unknown key", f"did you mean {near}?" if near else None))
        else:
            report.findings += check_value(key, value)
    given = {k: v for k, v in config.items() if k in KINDS and v is not None}
    value_of = lambda k: given.get(k, getattr(Options, k.replace("-", "_")))
    chosen = [k for k, v in given.items() if not (KINDS[k] == "flag" and v is not True)]
    if value_of("format") in FORMATS and value_of("json-mode") in JSON_MODES:
        for need in NEEDS:
            lacks = need.lacks(value_of) if need.key in chosen else ""
            if lacks:
                report.findings.append(Finding("error" if need.refused else "warning", need.key, f"needs {lacks}", "set that, or leave this out"))
        if "lazy" in chosen and "out-dir" not in chosen:
            report.findings.append(Finding("note", "lazy", "no folder is named for its files", "name one by out-dir or -o"))
        if isinstance(given.get("out-dir"), str) and (ending := _other_format(given["out-dir"], value_of("format"))):
            report.findings.append(Finding("warning", "out-dir", f"ends like {ending}, but the format is {value_of('format')}"))
        if "theme" in chosen and any(k in chosen for k in COLOUR_KEYS):
            report.findings.append(Finding("note", "theme", "single colours are set too, and hold"))
    if base and isinstance(config.get("cache-dir"), str) and (base / config["cache-dir"]).is_file():
        report.findings.append(Finding("error", "cache-dir", "is a file"))
    return report


def apply_config(config: dict | None, options: Options) -> Options:
    """options with what the config sets; a theme replaces the palette before single colours do."""
    out = options
    for key, value in (config or {}).items():
        if key not in KINDS or value is None:
            continue
        bad = [f for f in check_value(key, value) if f.severity == "error"]
        if bad:
            raise ValueError(f"{key}: {bad[0].message}")
        if key == "theme":
            out = replace(out, color_defined=None, color_postulate=None, color_hole=None, color_failed=None)
        out = replace(out, **{key.replace("-", "_"): tuple(value) if isinstance(value, list) else value})
    singles = {k.replace("-", "_"): config[k] for k in COLOUR_KEYS if config and config.get(k) is not None}
    return replace(out, **singles)


def parse_arguments(argv: list[str], seed: Options = Options()) -> tuple[Options, list[str]]:
    """Options of a command line over seed, and what is left: --key value or --key=value, -o value; -- ends them.

    Repeated values: lists add up, the last of others holds. A theme goes before single colours wherever it stands.
    """
    found: dict[str, object] = {}
    rest: list[str] = []
    lists: dict[str, list[str]] = {}
    i = 0
    while i < len(argv):
        word = argv[i]
        i += 1
        if word == "--":
            rest += argv[i:]
            break
        if word.startswith("-o") and not word.startswith("--"):
            word, i = (f"--out-dir={word[2:]}", i) if len(word) > 2 else (f"--out-dir={argv[i]}", i + 1) if i < len(argv) else (word, i)
        key, eq, value = word[2:].partition("=")
        if not word.startswith("--") or key not in KINDS:
            rest.append(word)
            continue
        if KINDS[key] == "flag":
            if eq:
                raise ValueError(f"--{key} takes no value")
            found[key] = True
            continue
        if not eq:
            if i >= len(argv):
                raise ValueError(f"--{key} needs a value")
            value, i = argv[i], i + 1
        if KINDS[key] == "list":
            lists.setdefault(key, []).append(value)
        elif KINDS[key] == "whole":
            if not value.isdecimal():
                raise ValueError(f"--{key}: {value!r} is not a whole number")
            found[key] = int(value)
        else:
            found[key] = value
    for key, values in lists.items():
        found[key] = [*getattr(seed, key.replace("-", "_")), *values]
    return apply_config(found, seed), rest


def compatible(o: Options) -> tuple[list[str], list[str]]:
    """(errors, notices) about options that don't go together; every entry point asks this one function."""
    errors, notices = [], []
    value_of = lambda k: getattr(o, k.replace("-", "_"))
    for need in NEEDS:
        asked = bool(value_of(need.key)) if KINDS[need.key] in ("flag", "list") else False
        lacks = need.lacks(value_of) if asked else ""
        if lacks:
            (errors if need.refused else notices).append(f"--{need.key} needs {lacks}")
    if "" in o.term_scope:
        errors.append("--term-scope: a module prefix can't be empty")
    if o.lazy and o.format == "json" and not o.out_dir:
        errors.append("--lazy needs out-dir")
    return errors, notices


#: What needs facts of a type checker, which the command line, reading source text alone, doesn't have.
ELABORATED = ("with-terms", "with-type-terms", "with-signatures", "normalise-signatures", "signature-implicits", "with-term-hashes", "term-scope", "keep-going", "lenient-imports", "resolve-deps")


def without_effect(o: Options) -> list[str]:
    """Errors about options that a scan of source text would ignore."""
    asked = [k for k in ELABORATED if getattr(o, k.replace("-", "_"))]
    return [f"--{k} needs elaborated facts; a scan of source text has none" for k in asked]


def find_config(cwd: Path, flag: str | None = None, env: str | None = None) -> tuple[Path | None, str]:
    """The config file and where it was named: a flag before the environment, the current folder, the nearest one above with a library file."""
    for name, origin in ((flag, "flag"), (env, "environment")):
        if name:
            if not Path(name).is_file():
                raise FileNotFoundError(f"the config that the {origin} names does not exist: {name}")
            return Path(name), origin
    if (cwd / CONFIG_NAME).is_file():
        return cwd / CONFIG_NAME, "folder"
    for up in cwd.resolve().parents:
        if any(up.glob(f"*{LIBRARY_SUFFIX}")):
            return (up / CONFIG_NAME, "library") if (up / CONFIG_NAME).is_file() else (None, "none")
    return None, "none"


def library_closure(libraries: dict[str, tuple[str, list[str]]], start: str) -> list[str] | None:
    """Folders of a library and all it depends on, in order of discovery; None if any is missing, so that all or none is pinned."""
    out, todo, seen = [], [start], set()
    while todo:
        name = todo.pop(0)
        if name in seen:
            continue
        seen.add(name)
        if name not in libraries:
            return None
        folder, depends = libraries[name]
        out.append(folder)
        todo += depends
    return out


def ownership(path: str, project: str | None, dependencies: dict[str, str]) -> str | None:
    """project, a dependency's name, or None: the longest root that contains the path, and of equals the dependency."""
    parts = Path(path).parts
    best: tuple[int, bool, str] | None = None
    for name, root in [*([("project", project)] if project else []), *dependencies.items()]:
        r = Path(root).parts
        if parts[: len(r)] == r and (best is None or (len(r), name != "project") > best[:2]):
            best = len(r), name != "project", name
    return best[2] if best else None


def show_defaults() -> str:
    """A config file with every key, commented out at its default."""
    show = {"flag": lambda v: str(v).lower(), "list": lambda v: "[]", "text": lambda v: v or "", "whole": str}
    return "".join(f"# {k}: {show[kind](getattr(Options, k.replace('-', '_')))}\n" for k, kind in KINDS.items())
