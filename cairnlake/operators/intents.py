"""Q02: imperative sentences to what they ask for. Only the parse is here: nothing acts on files."""

from __future__ import annotations

import re

PAGES = {"cleanup": "duplicates|cleanup|clean up", "settings": "settings|preferences", "people": "people|faces", "library": "library|files", "moments": "moments|timeline"}
SETTINGS = {"backgroundMotion": r"background (?:animation|motion)", "chatSummaries": r"summar(?:y|ies)", "cleanupAutoTag": r"tagging kept copies"}
COPIES = r"\b(?:duplicates?|extra copies|extras)\b"
JOBS = {"scan": r"scan\w*", "describe": r"describ\w*|descriptions?", "all": r"everything|all"}
THIS_IS_NOT = frozenset("great good nice fine cool bad wrong right it all done perfect awesome ok okay".split())


def _folder(text: str, said: str) -> str:
    """A folder as it was named: a path, a quoted or capitalised name, a well-known one, this one, or the library."""
    if m := re.search(r"[\"'“‘]([^\"'”’]+)[\"'”’]", said) or re.search(r"((?:/|~/|[A-Za-z]:\\)\S+)", said):
        return m[1]
    if m := re.search(r"\b(downloads|desktop|documents|pictures|movies|music)\b", text):
        return m[1]
    if m := re.search(r"(?:the|my) ([A-Z][\w ]*?) folder", said):
        return f"named:{m[1]}"
    return "this" if re.search(r"\bthis folder\b", text) else "library"


def _named(said: str) -> str:
    return " ".join(w if w[:1].isupper() else w.capitalize() for w in said.split())


def intent(question: str) -> dict | None:
    """{kind, ...} of a sentence that asks for an action, or None for one that asks a question."""
    said = re.sub(r"^(?:please|could you|can you|would you|now)\s+", "", question.strip().rstrip("?.!"), flags=re.I)
    text = said.lower()
    rest = lambda pattern: re.sub(pattern, "", text, count=1).strip()
    if m := re.match(r"turn (on|off)|(enable|disable)", text):
        on = (m[1] or m[2]) in ("on", "enable")
        found = next((k for k, p in SETTINGS.items() if re.search(p, text)), None)
        return {"kind": "changeSetting", "setting": found, "value": on} if found else {"kind": "refuse"}
    if m := re.match(r"(?:stop|cancel|pause)\s+(?:the )?(.+)", text):
        job = next((k for k, p in JOBS.items() if re.match(p, m[1])), None)
        return {"kind": "stopJob", "job": job} if job else None
    if re.match(r"undo\b", text):
        return {"kind": "undoLastMove", "folder": "library"}
    if re.match(r"re-?scan\b|re-?index\b|refresh\b|check for new\b", text) or re.match(r"scan\b.*\bagain$", text):
        return {"kind": "rescan", "folder": _folder(text, said)}
    if re.match(r"scan\b", text) or re.match(r"add (?:the |my )?.*folder$", text):
        return {"kind": "scanFolder", "folder": _folder(text, said)}
    if re.match(r"(?:move|delete|remove|trash|get rid of)\b", text):
        if re.search(COPIES, text):
            return {"kind": "moveDuplicatesToTrash", "scope": rest(r"^(?:move|delete|remove|trash|get)\s+")}
        return {"kind": "refuse"}
    if m := re.match(r"(?:open|go to|take me to|show)\s+(?:the |my )?(.+?)(?: page| tab)?$", text):
        page = next((k for k, p in PAGES.items() if re.fullmatch(p, m[1])), None)
        if page and not (text.startswith("show") and page in ("cleanup", "library")):
            return {"kind": "openPage", "page": page}
    if re.match(r"(?:find|show|list)\b", text) and re.search(COPIES, text):
        return {"kind": "findDuplicates", "scope": rest(r"^(?:find|show|list)\s+")}
    if m := re.match(r"find moments (?:when|where|of)\s+(.+)", said, re.I):
        return {"kind": "findMoments", "query": re.sub(r"\b(?:a|an|the)\s+", "", m[1])}
    if re.match(r"(?:apply|use|go with)\b.*\b(?:layout|plan)\b", text):
        return {"kind": "applyFolderLayout", "folder": _folder(text, said)}
    if re.match(r"(?:organi[sz]e|tidy(?: up)?|sort out|suggest a (?:folder )?layout)\b", text):
        return {"kind": "suggestFolderLayout", "folder": _folder(text, said)}
    if m := re.match(r"rename (.+?) to (?:the |their )?suggested names?|use (?:the |their )?suggested names?\s*(.*)", text):
        return {"kind": "renameToSuggested", "scope": (m[1] or m[2]).strip()}
    if m := re.match(r"(?:name|call) (?:this (?:person|one)|him|her|them)\s+(.+)", said, re.I) or re.match(r"this is ((?!the\b|a\b|my\b).+)", said, re.I):
        return None if m[1].lower() in THIS_IS_NOT else {"kind": "namePerson", "name": _named(m[1])}
    if m := re.match(r"merge (.+?) into (.+)", said, re.I):
        return {"kind": "mergePeople", "people": [m[2], m[1]]}
    if m := re.match(r"merge (.+?) and (.+)", said, re.I) or re.match(r"(.+?) and (.+?) are the same person", said, re.I):
        return {"kind": "mergePeople", "people": [m[1], m[2]]}
    if re.match(r"merge (?:these|those|them|the two)\b", text):
        return {"kind": "mergePeople"}
    if re.match(r"(?:describe|caption|write descriptions for)\b", text):
        return {"kind": "describeFiles", "scope": rest(r"^(?:describe|caption|write descriptions for)\s+")}
    if re.match(r"(?:export|save|make copies of|copy)\b", text):
        return {"kind": "exportFiles", "scope": rest(r"^(?:export|save|make copies of|copy)\s+")}
    if m := re.match(r"(?:search|look) for (.+)", said, re.I):
        return {"kind": "search", "query": m[1]}
    return None
