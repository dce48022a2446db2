"""Write the query catalogue (name, SQL twin or not, description) as Markdown."""

from __future__ import annotations

import inspect
import os
import sys

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

from tagweave.plans.catalog import all_oracles, all_queries  # noqa: E402

# Descriptions for the view-style queries whose functions carry no docstring.
FALLBACK = {
    "blessed_files": "Files carrying a non-general tag from the franchise list (A1).",
    "file_count": "Number of franchise files (A2).",
    "general_tag_count": "Distinct general tags of the franchise files (A4).",
    "general_tag_count_popular": "General tags seen more than 40 times there (A5).",
    "general_tag_prevalence": "Count per general tag of the franchise files (A6, flagship).",
    "general_tag_prevalence_popular": "Same, count above 30 (A7).",
    "general_tags": "Distinct general tags of the franchise files (A8).",
    "non_general_tag_count": "Distinct non-general tags of the franchise files (A9).",
    "non_general_tag_count_popular": "Non-general tags seen more than 40 times there (A10).",
    "non_general_tag_prevalence": "Count per non-general tag (A11).",
    "non_general_tag_prevalence_popular": "Same, count above 30 (A12).",
    "non_general_tags": "Distinct non-general tags (A13).",
    "names_of_files_with_general_list": "Non-general tags of files with a listed general tag (A3, J2).",
    "general_label_prevalence": "Corpus prevalence per ASCII-lower-cased general label (A14).",
    "name_label_prevalence": "Corpus prevalence per non-general label (A15).",
    "frames": "One row per file and frame number below its frame count (J4, S5, U2).",
    "validation_files": "First 128 files of the chosen franchises in key order (O4).",
    "test_files": "All other files (O5, J3).",
    "tag_key_duplicates": "Tag rows violating the (booru, fid, tag) key (X1).",
    "file_key_duplicates": "File rows violating the (booru, fid) key (X1).",
    "orphan_tags": "Tag rows without a file (X2).",
    "file_null_counts": "NULL count per files column (X3).",
    "files_without_tags": "Files with no tag rows (X2 / J5).",
    "general_token_counts": "Weighted token counts of general labels (A16, T1).",
    "general_tokens": "Ranked general tokens with count >= 31 (T2, O8).",
    "label_tokens": "Ranked name labels with prevalence >= 83 (T3, O7).",
    "registry_a": "Token registry A: pad, unk, labels, general tokens (T4, U4).",
    "registry_b": "Token registry B for text: pad, eos, unk, labels not in general, words, extra ids (T5, U5).",
    "file_md5_index": "Position of every file in MD5 order (W1, O1).",
    "file_splits": "Test / validation / train split of every file (W2, W5).",
    "mlm_chunks": "Span-corrupted chunks of the tokenised documents (W10, M2-M6).",
}


def main() -> None:
    qs, sql = all_queries(), all_oracles()
    print("# Query catalogue\n")
    print("Every entry of `__spark_entry__.queries()`: `fn(spark, sf_dir) -> DataFrame`.")
    print("Twin = a DuckDB SQL twin in `oracle_sql()` (row-by-row equal at sf0.01).\n")
    print("| Query | Twin | What it computes |")
    print("| --- | --- | --- |")
    for name, fn in qs.items():
        doc = inspect.getdoc(fn)
        text = " ".join(doc.split()) if doc else FALLBACK.get(name, "")
        print(f"| `{name}` | {'yes' if name in sql else 'rows only'} | {text} |")


if __name__ == "__main__":
    main()
