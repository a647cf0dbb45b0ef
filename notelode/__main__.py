"""python -m notelode <input_dir> <output_dir>: concepts of every text file, as one JSON file each."""

from __future__ import annotations

import os
import sys

from pyspark.sql import functions as F

from notelode.plans.pipeline import extract_concepts
from notelode.session import local_session
from notelode.sources.files import in_file_order, numeric_order, read_text_files, write_json_files
from notelode.sources.shared import Folder


def main(args: list[str]) -> int:
    if len(args) != 2:
        print("Usage: python -m notelode <input_dir> <output_dir>")
        return 1
    spark = local_session(os.cpu_count() or 1)
    Folder(spark, args[1]).make()
    # Record ids are checked before anything is written.
    notes = read_text_files(spark, args[0])
    wrong = notes.select("record_id").filter(numeric_order(F.col("record_id")).isNull()).take(1)
    if wrong:
        raise ValueError(f"not a number: {wrong[0][0]!r}")
    n = write_json_files(extract_concepts(in_file_order(notes)), args[1])
    print(f"{n} files processed, results in {args[1]}")
    return 0


if __name__ == "__main__":
    sys.exit(main(sys.argv[1:]))
