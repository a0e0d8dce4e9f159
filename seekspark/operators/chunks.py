"""Texts to chunks: whole files, byte windows, statement blocks, headers; and extractors of definitions, imports and calls."""

from __future__ import annotations

import ast
import json
import re
import tomllib
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

MAX_BYTES, SIZE, OVERLAP = 4096, 2048, 512


def whole_files(docs: DataFrame, path: str = "path", text: str = "text", limit: int = MAX_BYTES) -> DataFrame:
    """One chunk for each text that is not blank and within the limit. A column `hash` is kept."""
    ok = docs.where((F.octet_length(text) <= limit) & F.col(text).rlike(r"\S"))
    breaks = F.octet_length(text) - F.octet_length(F.replace(text, F.lit("\n"), F.lit("")))
    end = breaks + F.when(F.endswith(text, F.lit("\n")), 0).otherwise(1)
    return ok.select(path, F.regexp_extract(path, "[^/]*$", 0).alias("name"), F.lit("file").alias("kind"), F.lit(1).alias("start_line"), end.cast("int").alias("end_line"), F.col(text).alias("content"), *_hash(docs))


def _hash(files: DataFrame) -> list[str]:
    return ["hash"] if "hash" in files.columns else []


def windows(docs: DataFrame, path: str = "path", text: str = "text", size: int = SIZE, overlap: int = OVERLAP) -> DataFrame:
    """Byte windows cut after their last line break; those that then still cut a character or are blank give no row."""
    step = max(size - overlap, 1)
    rows = docs.where(F.octet_length(text) > 0).select(path, F.encode(text, "UTF-8").alias("raw"), F.octet_length(text).alias("n"))
    rows = rows.select(path, "raw", "n", F.explode(F.sequence(F.lit(0), F.col("n") - 1, F.lit(step))).alias("off"))
    part = F.substr("raw", F.col("off") + 1, F.lit(size))
    # bytes up to the last line break; substring_index works on bytes, so a character cut at the raw end does no harm
    cut = F.octet_length(part) - F.octet_length(F.substring_index(part.cast("string"), "\n", -1))
    keep = F.when((F.col("off") + size >= F.col("n")) | (cut == 0), F.lit(size)).otherwise(cut)
    rows = rows.withColumn("part", F.substr("raw", F.col("off") + 1, keep).cast("string"))
    content = F.when(F.is_valid_utf8("part"), F.col("part"))
    head = F.substr("raw", F.lit(1), F.col("off")).cast("string")
    lines = (F.length(head) - F.length(F.replace(head, F.lit("\n"), F.lit("")))) + 1
    out = rows.select(path, "off", content.alias("content"), lines.cast("int").alias("start_line"))
    return out.where(F.col("content").isNotNull() & (F.trim(F.regexp_replace("content", r"(?U)\s", " ")) != "")).withColumn("kind", F.lit("window"))


def rdf_blocks(lines: DataFrame, key: str, pos: str, line: str) -> DataFrame:
    """Statement blocks of line rows: a blank line ends one, so does a line that ends in a full stop, and a directive's end."""
    from pyspark.sql import Window as W

    directive = F.col(line).startswith("@prefix") | F.col(line).startswith("@base") | F.col(line).startswith("PREFIX") | F.col(line).startswith("BASE")
    w = W.partitionBy(key).orderBy(pos)
    rows = lines.withColumns({"dir": directive, "blank": F.trim(line) == ""})
    rows = rows.withColumn("ends", F.col("blank") | (~F.col("dir") & F.rtrim(line).endswith(".")))
    before = F.coalesce(F.lag("ends").over(w), F.lit(False)) | (F.coalesce(F.lag("dir").over(w), F.lit(False)) & ~F.col("dir"))
    rows = rows.withColumn("block", F.sum(before.cast("int")).over(w)).where(~F.col("blank"))
    out = rows.groupBy(key, "block").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct(F.col(pos).alias("p"), F.col(line).alias("l")))), lambda x: x["l"]), "\n").alias("content"), F.min(pos).alias("start"), F.max(pos).alias("end"))
    first = F.regexp_extract("content", r"(?m)^\s*([^\s#]\S*)", 1)
    return out.withColumn("name", F.regexp_replace(first, "[;,.]+$", ""))


def header(path: str, scope: str, signature: str) -> str:
    parts = [path, *([scope] if scope else []), *([f"defines: {signature}"] if signature else [])]
    return "// " + " | ".join(parts) + "\n"


def squeezed(text: str) -> str:
    """Trailing blanks go, indentation halves (a tab counts as two), runs of blank lines become one."""
    out: list[str] = []
    for line in text.split("\n"):
        line = line.rstrip()
        if not line and len(out) > 1 and not out[-1] and not out[-2]:
            continue
        lead = len(line) - len(line.lstrip(" \t"))
        wide = sum(2 if c == "\t" else 1 for c in line[:lead])
        out.append(" " * -(-wide // 2) + line[lead:])
    return "\n".join(out)


def enriched(path: str, scope: str, signature: str, content: str, limit: int = MAX_BYTES) -> str:
    """The squeezed content under its header, without the header where both would be over the limit."""
    body = squeezed(content)
    whole = header(path, scope or "", signature or "") + body
    return whole if len(whole.encode()) <= limit else body


def cut_windows(text: str, size: int = SIZE, overlap: int = OVERLAP) -> Iterator[tuple[int, str]]:
    """(first line, content) of a text's byte windows, as `windows` cuts them, in one pass over its lines."""
    raw, line, counted = text.encode("utf-8", "surrogatepass"), 1, 0
    for off in range(0, len(raw), max(size - overlap, 1)):
        line, counted = line + raw.count(b"\n", counted, off), off
        part = raw[off : off + size]
        if off + size < len(raw) and b"\n" in part:
            part = part[: part.rfind(b"\n") + 1]
        try:
            content = part.decode()
        except UnicodeDecodeError:
            continue
        if content.strip():
            yield line, content


def _split(path: str, name: str, first: int, text: str, limit: int) -> list[tuple]:
    return [(path, f"{name}[{i}]", "window", first + line - 1, first + line - 1 + content.rstrip("\n").count("\n"), content, content) for i, (line, content) in enumerate(cut_windows(text))]


def _whole(path: str, text: str, limit: int) -> list[tuple]:
    if not text.strip():
        return []
    base = path.rsplit("/", 1)[-1]
    if len(text.encode()) > limit:
        return _split(path, base, 1, text, limit)
    return [(path, base, "file", 1, max(1, len(text.splitlines())), text, text)]


def _syntax(path: str, ext: str, text: str, limit: int) -> list[tuple]:
    """One chunk for each definition, windows of those over the limit, the whole file where none is found."""
    lines, out = text.split("\n"), []
    for d in extract(ext, text):
        if d["record"] == "def":
            content = "\n".join(lines[d["start_line"] - 1 : d["end_line"]])
            if len(content.encode()) > limit:
                out += _split(path, d["name"], d["start_line"], content, limit)
            elif content.strip():
                out.append((path, d["name"], d["kind"], d["start_line"], d["end_line"], content, enriched(path, d.get("scope") or "", d.get("signature") or "", content, limit)))
    return out or _whole(path, text, limit)


def _rdf(path: str, text: str, limit: int) -> list[tuple]:
    """One chunk for each statement block, under a header where that fits."""
    out, block, first, base = [], [], 0, path.rsplit("/", 1)[-1]

    def flush() -> None:
        content = "\n".join(line for _, line in block)
        if content.strip():
            name = next((x.strip() for _, x in block if x.strip() and not x.strip().startswith("#")), "")
            name = "@prefix" if name.startswith(("@prefix", "PREFIX")) else "@base" if name.startswith(("@base", "BASE")) else (name.split() or [""])[0].rstrip(";,.") or base
            if len(content.encode()) > limit:
                out.extend(_split(path, name, block[0][0], content, limit))
            else:
                whole = f"# {path} | rdf: {name}\n{content}"
                out.append((path, name, "rdf_statements", block[0][0], block[-1][0], content, whole if len(whole.encode()) <= limit else content))
        block.clear()

    directive = ("@prefix", "@base", "PREFIX", "BASE")
    for i, line in enumerate(text.split("\n"), 1):
        here = line.startswith(directive)
        if block and block[-1][1].startswith(directive) and not here:
            flush()
        if not line.strip():
            flush()
            continue
        block.append((i, line))
        if not here and line.rstrip().endswith("."):
            flush()
    flush()
    return out


RDF_EXTENSIONS = ("ttl", "nt", "n3", "trig", "nq")
CHUNK = "path string, name string, kind string, start_line int, end_line int, content string, enriched string"


def chunked(path: str, text: str | None, text_mode: bool = False, limit: int = MAX_BYTES) -> list[tuple]:
    """The chunks of one file: by syntax, by statement block, or by windows, as its extension says; by windows in text mode."""
    ext, text = path.rsplit(".", 1)[-1].lower(), text or ""
    if not text_mode and ext in EXTENSIONS:
        return _syntax(path, ext, text, limit)
    if not text_mode and ext in RDF_EXTENSIONS:
        return _rdf(path, text, limit)
    return _whole(path, text, limit)


def dispatch(files: DataFrame, path: str = "path", text: str = "text", text_mode: bool = False, limit: int = MAX_BYTES) -> DataFrame:
    """(path, name, kind, start_line, end_line, content, enriched) of all files. Null and blank texts have no chunk. A column `hash` is kept."""
    kept = _hash(files)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        names = [x.split()[0] for x in CHUNK.split(", ")] + kept
        for b in batches:
            rows = [(*c, *k) for p, t, *k in zip(b[path], b[text], *(b[x] for x in kept)) if p is not None for c in chunked(p, t, text_mode, limit)]
            yield pd.DataFrame(rows, columns=names).astype({"start_line": "int32", "end_line": "int32"})

    return files.select(path, text, *kept).mapInPandas(run, CHUNK + "".join(f", {x} string" for x in kept))


# --- extractors: path and text to definitions (name, kind, start_line, end_line, scope, signature), imports and calls ---


def _python(text: str) -> list[dict]:
    out: list[dict] = []
    tree = ast.parse(text)

    def walk(node: ast.AST, scope: list[str], inside: list[str]) -> None:
        for child in ast.iter_child_nodes(node):
            named = isinstance(child, (ast.FunctionDef, ast.AsyncFunctionDef, ast.ClassDef))
            if named:
                kind = "class_definition" if isinstance(child, ast.ClassDef) else "function_definition"
                args = f"{child.name}({ast.unparse(child.args)})" if hasattr(child, "args") else child.name
                out.append({"record": "def", "name": child.name, "kind": kind, "start_line": child.lineno, "end_line": child.end_lineno, "scope": " > ".join(scope), "signature": args})
            elif isinstance(child, ast.Assign) and isinstance(child.targets[0], ast.Name):
                out.append({"record": "def", "name": child.targets[0].id, "kind": "assignment", "start_line": child.lineno, "end_line": child.end_lineno, "scope": " > ".join(scope), "signature": None})
            elif isinstance(child, ast.Import):
                out.extend({"record": "import", "name": a.name, "kind": "import", "start_line": child.lineno, "end_line": child.end_lineno} for a in child.names)
            elif isinstance(child, ast.ImportFrom):
                out.append({"record": "import", "name": "." * child.level + (child.module or ""), "kind": "import", "start_line": child.lineno, "end_line": child.end_lineno})
            elif isinstance(child, ast.Call) and inside:
                callee = child.func.attr if isinstance(child.func, ast.Attribute) else child.func.id if isinstance(child.func, ast.Name) else None
                if callee and callee != inside[-1]:
                    out.append({"record": "call", "name": callee, "kind": "call", "start_line": child.lineno, "end_line": child.end_lineno, "scope": inside[-1]})
            walk(child, scope + [f"{'class' if isinstance(child, ast.ClassDef) else 'function'}_definition {child.name}"] if named else scope, inside + [child.name] if named else inside)

    walk(tree, [], [])
    return out


#: (extensions, kind, pattern of a definition's first line with its name), for languages whose blocks stand in braces.
BRACES = [
    (("rs",), "function_item", r"^\s*(?:pub(?:\([^)]*\))?\s+)?(?:async\s+|unsafe\s+|const\s+)*fn\s+(\w+)"),
    (("rs",), "struct_item", r"^\s*(?:pub(?:\([^)]*\))?\s+)?struct\s+(\w+)"),
    (("rs",), "enum_item", r"^\s*(?:pub(?:\([^)]*\))?\s+)?enum\s+(\w+)"),
    (("rs",), "trait_item", r"^\s*(?:pub(?:\([^)]*\))?\s+)?trait\s+(\w+)"),
    (("rs",), "impl_item", r"^\s*impl(?:<[^>]*>)?\s+(?:[\w:<>]+\s+for\s+)?(\w+)"),
    (("rs",), "mod_item", r"^\s*(?:pub\s+)?mod\s+(\w+)"),
    (("js", "jsx", "ts", "tsx"), "function_declaration", r"^\s*(?:export\s+)?(?:default\s+)?(?:async\s+)?function\s*\*?\s*(\w+)"),
    (("js", "jsx", "ts", "tsx"), "class_declaration", r"^\s*(?:export\s+)?(?:default\s+)?(?:abstract\s+)?class\s+(\w+)"),
    (("js", "jsx", "ts", "tsx"), "method_definition", r"^\s+(?:static\s+|async\s+|get\s+|set\s+)*(?!if\b|for\b|while\b|switch\b|catch\b|return\b)(\w+)\s*\([^)]*\)\s*\{"),
    (("js", "jsx", "ts", "tsx"), "variable_declarator", r"^\s*(?:export\s+)?(?:const|let|var)\s+(\w+)\s*="),
    (("ts", "tsx"), "interface_declaration", r"^\s*(?:export\s+)?interface\s+(\w+)"),
    (("ts", "tsx"), "type_alias_declaration", r"^\s*(?:export\s+)?type\s+(\w+)"),
    (("go",), "function_declaration", r"^func\s+(?:\([^)]*\)\s*)?(\w+)"),
    (("go",), "type_declaration", r"^type\s+(\w+)"),
    (("java", "kt", "scala", "swift", "cpp", "cc", "hpp"), "class_declaration", r"^\s*(?:\w+\s+)*(?:class|interface|object|trait|protocol|enum|struct)\s+(\w+)"),
    (("java", "c", "h", "cpp", "cc", "hpp"), "method_declaration", r"^\s*(?:[\w<>\[\]*&:]+\s+)+\**(?!if\b|for\b|while\b|switch\b|return\b)(\w+)\s*\([^;]*\)\s*(?:const\s*)?(?:throws\s+[\w, ]+)?\{"),
    (("kt", "swift", "scala"), "function_declaration", r"^\s*(?:\w+\s+)*(?:fun|func|def)\s+(\w+)"),
    (("sh", "bash"), "function_definition", r"^\s*(?:function\s+)?(\w+)\s*\(\)\s*\{"),
]
LINES = [
    (("rb",), "method", r"^\s*def\s+(?:self\.)?(\w+[?!]?)"),
    (("rb",), "class", r"^\s*(?:class|module)\s+([\w:]+)"),
    (("md", "markdown"), "atx_heading", r"^#{1,6}\s+(.+?)\s*#*$"),
    (("toml",), "table", r"^\s*\[+([^\]]+)\]+"),
    (("toml",), "pair", r"^\s*([\w.\"-]+)\s*="),
    (("yaml", "yml"), "block_mapping_pair", r"^\s*(?:- )?([\w.-]+):(?:\s|$)"),
    (("json",), "pair", r"^\s*\"([^\"]+)\"\s*:"),
    (("xml", "rdf", "owl"), "element", r"<([A-Za-z][\w:.-]*)"),
    (("hcl", "tf"), "block", r"^\s*(\w+)(?:\s+\"[^\"]*\")*\s*\{"),
]
IMPORTS = [(("rs",), r"^\s*(?:pub\s+)?use\s+([\w:]+)"), (("js", "jsx", "ts", "tsx"), r"(?:from\s+|require\(\s*|^\s*import\s+)[\"']([^\"']+)[\"']"), (("go",), r"^\s*(?:import\s+)?(?:\w+\s+)?\"([^\"]+)\""), (("rb",), r"^\s*require(?:_relative)?\s+[\"']([^\"']+)")]


EXTENSIONS = frozenset(["py", "pyi", *(e for exts, _, _ in BRACES + LINES for e in exts)])
#: Languages by extension, for result sinks.
LANGUAGES = {"rs": "rust", "py": "python", "pyi": "python", "js": "javascript", "jsx": "javascript", "ts": "typescript", "tsx": "tsx", "go": "go", "java": "java", "c": "c", "h": "c", "cpp": "cpp", "cc": "cpp", "hpp": "cpp", "rb": "ruby", "sh": "bash", "bash": "bash", "md": "markdown", "json": "json", "yaml": "yaml", "yml": "yaml", "toml": "toml"}


def language(path: Column) -> Column:
    """The language of a path's extension, or `text`."""
    table = F.create_map(*[F.lit(x) for kv in LANGUAGES.items() for x in kv])
    return F.coalesce(F.try_element_at(table, F.lower(F.regexp_extract(path, r"\.([^./]*)$", 1))), F.lit("text"))


def _close(lines: list[str], at: int) -> int:
    """The line on which the brace opened at or after a line closes; the line itself if none opens before a semicolon."""
    depth = 0
    for i in range(at, len(lines)):
        bare = re.sub(r"\"(?:\\.|[^\"\\])*\"|'(?:\\.|[^'\\])*'|//.*$", "", lines[i])
        depth += bare.count("{") - bare.count("}")
        if depth <= 0 and ("}" in bare or ";" in bare):
            return i
    return at if depth <= 0 else len(lines) - 1


def _lines(ext: str, text: str) -> list[dict]:
    lines, out = text.split("\n"), []
    for i, line in enumerate(lines):
        for exts, kind, pattern in BRACES + LINES:
            if ext in exts:
                for m in re.finditer(pattern, line) if kind == "element" else filter(None, [re.match(pattern, line)]):
                    end = _close(lines, i) if (exts, kind, pattern) in BRACES else i
                    out.append({"record": "def", "name": m[1].strip('"'), "kind": kind, "start_line": i + 1, "end_line": end + 1, "signature": line.split("{")[0].strip() or None})
        for exts, pattern in IMPORTS:
            if ext in exts:
                out.extend({"record": "import", "name": m[1], "kind": "import", "start_line": i + 1, "end_line": i + 1} for m in re.finditer(pattern, line))
    defs = [d for d in out if d["record"] == "def"]
    open_: list[dict] = []
    for d in defs:  # in order of their first lines
        while open_ and open_[-1]["end_line"] < d["start_line"]:
            open_.pop()
        d["scope"] = " > ".join(f"{x['kind']} {x['name']}" for x in open_ if x["end_line"] >= d["end_line"])
        if d["end_line"] > d["start_line"]:
            open_.append(d)
    if any(ext in exts for exts, _, _ in BRACES):
        holders, at, open_ = [d for d in defs if d["kind"] not in ("struct_item", "enum_item", "variable_declarator")], 0, []
        for i, line in enumerate(lines):
            while at < len(holders) and holders[at]["start_line"] <= i + 1:
                open_.append(holders[at])
                at += 1
            while open_ and open_[-1]["end_line"] < i + 1:
                open_.pop()
            around = [d for d in open_ if d["end_line"] >= i + 1]
            if around:
                inner = min(around, key=lambda d: d["end_line"] - d["start_line"])
                out.extend({"record": "call", "name": m, "kind": "call", "start_line": i + 1, "end_line": i + 1, "scope": inner["name"]} for m in re.findall(r"(?<!fn )(?<!function )\b(\w+)\s*\(", line) if m != inner["name"] and m not in ("if", "for", "while", "switch", "return", "catch", "fn", "function"))
    return out


def extract(ext: str, text: str) -> list[dict]:
    """Records of one file; none for extensions without an extractor or for texts that its parser rejects."""
    try:
        return _python(text) if ext in ("py", "pyi") else _lines(ext, text)
    except (SyntaxError, ValueError, RecursionError):
        return _outline(text)


def _outline(text: str) -> list[dict]:
    """Definitions and imports of Python text that does not parse: lines that begin one, to the last line indented below it."""
    lines, out = text.split("\n"), []
    for i, line in enumerate(lines):
        if m := re.match(r"(\s*)(?:async\s+)?(def|class)\s+(\w+)", line):
            end = i
            while end + 1 < len(lines) and (not lines[end + 1].strip() or len(lines[end + 1]) - len(lines[end + 1].lstrip()) > len(m[1])):
                end += 1
            while end > i and not lines[end].strip():
                end -= 1
            out.append({"record": "def", "name": m[3], "kind": "class_definition" if m[2] == "class" else "function_definition", "start_line": i + 1, "end_line": end + 1, "scope": "", "signature": None})
        elif m := re.match(r"\s*(?:import\s+([\w.]+)|from\s+([\w.]+)\s+import\b)", line):
            out.append({"record": "import", "name": m[1] or m[2], "kind": "import", "start_line": i + 1, "end_line": i + 1})
    return out


def diagnostics(ext: str, text: str) -> list[tuple[int, str]]:
    """Syntax errors as (line, message), for Python, JSON and TOML."""
    try:
        if ext in ("py", "pyi"):
            ast.parse(text)
        elif ext == "json":
            json.loads(text)
        elif ext == "toml":
            tomllib.loads(text)
    except SyntaxError as e:
        return [(e.lineno or 1, e.msg)]
    except ValueError as e:
        return [(getattr(e, "lineno", 1), str(e)[:80])]
    return []


RECORDS = "path string, record string, name string, kind string, start_line int, end_line int, scope string, signature string"


def extracted(files: DataFrame, path: str = "path", text: str = "text") -> DataFrame:
    """Definitions, imports and calls of files, one row each."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        names = [x.split()[0] for x in RECORDS.split(", ")]
        for b in batches:
            rows = [{"path": p} | r for p, t in zip(b[path], b[text]) for r in extract(p.rsplit(".", 1)[-1].lower(), t or "")]
            yield pd.DataFrame(rows, columns=names).astype({"start_line": "int32", "end_line": "int32"})

    return files.select(path, text).mapInPandas(run, RECORDS)
