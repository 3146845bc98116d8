"""Driver-side text functions for questions and interests: the same rules as the Column functions, for a few words."""

from __future__ import annotations

import re
import unicodedata

from pressloom.functions.text import EDGES, STOPWORDS, TOKEN


def fold_text(text: str) -> str:
    return "".join(c for c in unicodedata.normalize("NFKD", (text or "").lower()) if not unicodedata.combining(c)).strip()


def token_list(text: str, drop_stopwords: bool = True) -> list[str]:
    found = (w.strip(EDGES) for w in re.findall(TOKEN, fold_text(text)))
    return [w for w in found if len(w) >= 2 and not (drop_stopwords and w in STOPWORDS)]
