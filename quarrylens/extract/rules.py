"""How imports look in languages whose imports are read."""

from __future__ import annotations

# What names a module, in texts whose comments are blanked.
IMPORTS = {
    "javascript": r"(?:^|[;}])[^\S\n]*(?:import|export)\b(?:[^;'\"`]*?\bfrom\b)?\s*(?P<q>['\"])(?P<module>[^'\"\n]+)(?P=q)",
    "rust": r"(?:^|[;{}])[^\S\n]*(?:pub(?:\([^)]*\))?\s+)?(?:use\s+(?P<module>[^;]+);|extern\s+crate\s+(?P<crate>\w+))",
    "c": r"^[ \t]*#[ \t]*include[ \t]*(?P<module><[^>\n]+>|\"[^\"\n]+\")", "java": r"(?:^|;)[^\S\n]*import\s+(?:static\s+)?(?P<module>[\w.]+(?:\.\*)?)\s*;",
}
IMPORTS["typescript"] = IMPORTS["tsx"] = IMPORTS["javascript"]
IMPORTS["cpp"] = IMPORTS["c"]
