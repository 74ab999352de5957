"""Types of the data model: boxes, lines, pages, wire formats and telemetry."""

from __future__ import annotations

BOX = "struct<x1: int, y1: int, x2: int, y2: int>"
LINE = "struct<text: string, x1: int, y1: int, x2: int, y2: int>"
LINES = f"array<{LINE}>"

#: One page: the row all scans yield. Pixels stay in another table, so metadata queries never read them.
PAGE = f"page_id string, page_no int, img_w int, img_h int, lines {LINES}, task string, query_text string, query_bbox {BOX}, source string, meta map<string, string>"

# Tasks and manifest versions.
TASKS = ("ocr", "ocr_layout", "region_ocr", "find_it")
DEFAULT_TASK = "ocr_layout"
MANIFEST_VERSIONS = (1,)

#: Sidecar of nested-page shards: pages[].lines.{text, bbox, score}.
NESTED_PAGES = "struct<pages: array<struct<lines: struct<text: array<string>, bbox: array<array<double>>, score: array<double>>>>>"
#: Sidecar of parallel-array shards: pages[].{text, bbox, score}.
FLAT_PAGES = "struct<pages: array<struct<text: array<string>, bbox: array<array<double>>, score: array<double>>>>"
#: Paragraph annotations of scene and page text.
PARAGRAPHS = "struct<paragraphs: array<struct<lines: array<struct<vertices: array<array<double>>, text: string, legible: boolean, handwritten: boolean, vertical: boolean>>>>>"
#: Language pages: lang, lines[].{text, bbox | box}.
LANGUAGE_PAGE = "struct<lang: string, lines: array<struct<text: string, bbox: array<int>, box: array<int>>>>"

EVENT = (
    "seq long, sub int, event string, attempt int, stage int, step long, loss double, text_loss double, loc_loss double, lr double, val_loss double, "
    "cer double, wer double, word_f1 double, decoded int, empty int, streak int, rate double, window_s double, n_steps long, wall_s double, per_step_s double, "
    "loss_first double, loss_last double, loss_delta double, exit_code int, restart_streak int, alert boolean, snippet string"
)
