"""python -m attestra list | run QUERY FOLDER [OUT] | cards MANIFEST OUT | hashes FOLDER OUT"""

from __future__ import annotations

import sys

from .plans import catalogue
from .session import session
from .sources import cards, files


def main(args: list[str]) -> int:
    match args:
        case ["list"]:
            print("\n".join(sorted(catalogue.QUERIES)))
        case ["run", name, folder]:
            catalogue.QUERIES[name](session(), folder).show(50, truncate=False)
        case ["run", name, folder, out]:
            catalogue.QUERIES[name](session(), folder).write.parquet(out)
        case ["cards", manifest, out]:
            entries = [(e["artifact_id"], e["path"], e.get("selected_columns")) for e in files.read_manifest(manifest)["artifacts"]]
            asked = session().createDataFrame(entries, "artifact_id string, path string, selected_columns array<string>")
            files.write_jsonl(cards.file_cards(asked), out)
        case ["hashes", folder, out]:
            files.write_jsonl(cards.file_hashes(session(), folder), out)
        case _:
            print(__doc__)
            return 2
    return 0


if __name__ == "__main__":
    sys.exit(main(sys.argv[1:]))
