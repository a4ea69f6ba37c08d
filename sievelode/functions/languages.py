"""Language of a source file, told by its ending, its stated language or its text."""

from __future__ import annotations

import re

#: Family of each language and file ending; everything else is read as configuration.
FAMILIES = {
    "python": "py", "py": "py", "pyi": "py", "javascript": "js", "js": "js", "jsx": "js", "mjs": "js", "cjs": "js", "ts": "js",
    "tsx": "js", "typescript": "js", "java": "java", "go": "go", "golang": "go",
    "config": "conf", "yaml": "conf", "yml": "conf", "toml": "conf", "ini": "conf", "cfg": "conf", "conf": "conf", "env": "conf",
    "properties": "conf", "json": "conf", "sh": "conf",
}


def family(lang: str | None, path: str | None, text: str | None = None) -> str:
    """Family of a file by its ending, else by its language, else by what its text looks like."""
    name = (path or "").replace("\\", "/").rsplit("/", 1)[-1]
    if "." in name and (found := FAMILIES.get(name.rsplit(".", 1)[1].lower())):
        return found
    if found := FAMILIES.get((lang or "").strip().lower()):
        return found
    text = text or ""
    if re.search(r"^package \w+\s*$", text, re.M) and "func " in text:
        return "go"
    if re.search(r"^import [\w.]+\w;\r?$|^\s*public (?:final |abstract )?(?:class|interface|enum) ", text, re.M):
        return "java"
    if re.search(r"^\s*(?:async )?def \w+\(|^from [\w.]+ import |^class \w+[^{]*:\s*$", text, re.M):
        return "py"
    if re.search(r"^\s*(?:export |import .* from |const \w+ = |let |function )|=> \{|\bmodule\.exports\b", text, re.M):
        return "js"
    return "conf"
