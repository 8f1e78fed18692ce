"""Fixed schemas of the tables, as DDL strings."""

PAPER = "id STRING, title STRING, abstract STRING, updated STRING, published STRING, pdf_link STRING"
SENTENCE = "STRUCT<sentence_id: INT, text: STRING, label: INT>"
CORPUS_FIELDS = f"paper_name STRING, section STRING, paragraph_id INT, full_text STRING, sentences ARRAY<{SENTENCE}>"
CORPUS_ITEM = f"STRUCT<{CORPUS_FIELDS}>"
CORPUS_FILE = f"data ARRAY<{CORPUS_ITEM}>"
LEDGER = "`Paper Link` STRING, `Dataset Link` STRING, `Dataset Description` STRING, Timestamp STRING"
PARTIAL = (
    "arxiv_id STRING, paper_link_pdf STRING, dataset_description STRING, abstract STRING, "
    "updated STRING, published STRING"
)
QUERY = (
    "query STRING, instruction STRING, positives STRING, ground_truth STRING, meta STRING, metadata STRING"
)
GATE_SAMPLE = "title STRING, abstract STRING, text STRING, label INT, has_dataset INT"
RESPONSE_ITEM = "STRUCT<url: STRING, label: STRING, why: STRING, desc: STRING>"
