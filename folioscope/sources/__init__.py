"""Where documents and pages come from. Every source gives pages as (doc_id string, page int, text string)."""
