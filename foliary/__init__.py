"""foliary: a PySpark-native engine for turning documents into typed, checked records.

The names in PUBLIC are the library's interface (UDX11); each is loaded when it is first asked for.
"""

from importlib import import_module

PUBLIC = {
    "read_documents": "sources.formats", "detect_format": "sources.formats", "html_text": "sources.formats", "docx_text": "sources.docx", "image_size": "sources.images", "ocr_languages": "sources.images",
    "watch": "streaming.inbox", "complete": "operators.model", "reading_order": "operators.reading_order", "judged": "operators.pages", "merged": "operators.pages", "recognize": "operators.adapters",
    "tidy": "operators.tidying", "ground_records": "operators.grounding", "score_records": "operators.scoring", "overall": "operators.scoring", "summary": "operators.report", "render": "operators.report",
    "System": "operators.runs", "predictions": "operators.runs", "people": "operators.synthetic", "normalize_date": "functions.dates", "date_range": "functions.dates", "degree_level": "functions.degrees",
    "json_schema": "functions.written", "queries": "catalog", "oracle_sql": "catalog",
}
__all__ = list(PUBLIC)


def __getattr__(name: str):
    if name not in PUBLIC:
        raise AttributeError(name)
    return getattr(import_module(f"foliary.{PUBLIC[name]}"), name)
