"""DuckDB SQL of the operators that SQL can express."""

from __future__ import annotations

from . import chat, resampling, url_lists

ORACLE: dict[str, str] = {
    "op7_chat_formatting": chat.oracle(),
    "op10_url_filters": url_lists.oracle(),
    "op12_importance_resampling": resampling.oracle(),
}
