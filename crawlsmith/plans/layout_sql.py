"""DuckDB SQL for a page without scripts, furniture and hidden elements."""

from __future__ import annotations


def layout(h: str) -> str:
    for tag in ("script", "style", "noscript"):
        h = rf"regexp_replace({h}, '(?is)<{tag}\b[^>]*>.*?</{tag}\s*>', ' ', 'g')"
    h = f"regexp_replace({h}, '(?s)<!--.*?-->', ' ', 'g')"
    for tag in ("header", "nav", "footer", "aside"):
        h = rf"regexp_replace({h}, '(?is)<{tag}\b[^>]*>.*?</{tag}\s*>', ' ', 'g')"
    return rf"""regexp_replace({h}, '(?is)<[^>]+(?:\shidden\b|display\s*:\s*none|aria-hidden=["'']true["''])[^>]*>.*?</[^>]+>', ' ', 'g')"""
