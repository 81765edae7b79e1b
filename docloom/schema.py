"""Schemas of the engine's tables, as DDL."""

BLOCKS = """document_id STRING, block_id STRING, block_type STRING, content STRING, source_file STRING,
 section_path ARRAY<STRING>, page INT, sheet_name STRING, cell_range STRING, reading_order INT,
 rows ARRAY<ARRAY<STRING>>, derived_from STRING, source_ranges ARRAY<STRING>, image_type STRING, numeric_repr STRING"""

EDGES = "source_id STRING, target_id STRING, relation_type STRING, document_id STRING"

CHUNKS = """chunk_id STRING, document_id STRING, source_file STRING, chunk_type STRING, content STRING,
 block_ids ARRAY<STRING>, ordinal INT, section_path ARRAY<STRING>, page_start INT, page_end INT, sheet_name STRING,
 cell_range STRING, table_file STRING, token_count INT"""

STATUS = """run_id STRING, document_id STRING, source_file STRING, stage STRING, status STRING, error_code STRING,
 message STRING, retryable BOOLEAN, duration_ms DOUBLE, created_at STRING"""

VISUAL_TYPES = ["image", "chart", "flowchart"]
TEXT_TYPES = ["text", "ocr_page", "caption", "heading"]
BLOCK_TYPES = [*TEXT_TYPES, "table", "kpi", *VISUAL_TYPES, "vlm"]
RELATION_TYPES = ["belongs_to_section", "captioned_by", "referenced_by", "visualizes", "continues", "next_in_reading_order", "derived_from"]
STAGES = ["parse", "ocr", "vlm", "ocr_correction", "chunk", "index"]
STATUSES = ["success", "partial", "failed", "skipped"]
