"""``python -m corvale create|reset|stats FOLDER``: make, empty or count a store."""

from __future__ import annotations

import argparse

from corvale.plans.indexes import Indexes
from corvale.session import session
from corvale.sources.store import Store


def main(arguments: list[str] | None = None) -> None:
    parser = argparse.ArgumentParser(prog="corvale", description="Make, empty or count a store.")
    parser.add_argument("command", choices=("create", "reset", "stats"))
    parser.add_argument("folder")
    own = parser.parse_args(arguments)
    store = Store(session("corvale-store"), own.folder)
    if own.command == "reset":
        store.drop()
    if own.command == "stats":
        for name in store.tables:
            print(f"{name}: {store.read(name).count()}")
    else:
        Indexes(store).seed()
        print(f"{own.folder} has {', '.join(store.tables)}")


if __name__ == "__main__":
    main()
