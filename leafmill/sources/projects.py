"""The index of projects and their configuration: small JSON documents that the driver owns."""

from __future__ import annotations

import json
import os
import shutil
from datetime import datetime, timezone
from pathlib import Path

from leafmill.sources.files import Config


class Projects:
    """Projects under one folder: an index file, and a folder with a configuration for each."""

    def __init__(self, folder: str):
        self.folder = Path(os.path.expanduser(folder))
        self.active: str | None = None

    @property
    def _index(self) -> Path:
        return self.folder / "projects.json"

    def list(self) -> list[dict]:
        """All projects; none if there is no readable index."""
        try:
            return json.loads(self._index.read_text())
        except (OSError, ValueError):
            return []

    def _save(self, path: Path, data) -> None:
        path.parent.mkdir(parents=True, exist_ok=True)
        part = path.with_suffix(".part")
        part.write_text(json.dumps(data, indent=2))
        part.replace(path)

    def create(self, name: str, config: dict | None = None) -> dict:
        """A new project; its id is the name in lower case with hyphens, with a number if it is taken."""
        stem = "".join(c if c.isascii() and c.isalnum() else "-" for c in name.lower())
        stem = "-".join(filter(None, stem.split("-")))[:40].rstrip("-") or "project"
        taken, n = {p["id"] for p in self.list()}, 1
        while (found := stem if n == 1 else f"{stem}-{n}") in taken:
            n += 1
        made = {"id": found, "name": name, "created_at": datetime.now(timezone.utc).isoformat(timespec="seconds")}
        self._save(self.folder / found / "config.json", config or {})
        self._save(self._index, [*self.list(), made])
        return made

    def delete(self, project: str, files: bool = False) -> bool:
        """Take a project off the index; its files stay unless asked for."""
        rest = [p for p in self.list() if p["id"] != project]
        gone = len(rest) < len(self.list())
        if gone:
            self._save(self._index, rest)
            self.active = None if self.active == project else self.active
            if files:
                shutil.rmtree(self.folder / project, ignore_errors=True)
        return gone

    def activate(self, project: str | None = None) -> Config | None:
        """Make a project the active one, the first if none is named; nothing if there is none."""
        known = [p["id"] for p in self.list()]
        chosen = project or (known[0] if known else None)
        if chosen not in known:
            return None
        self.active = chosen
        return self.config(chosen)

    def config(self, project: str) -> Config:
        return Config.load(str(self.folder / project / "config.json"), str(self.folder / project))

    def patch_config(self, project: str, changes: dict) -> Config:
        """Replace top-level keys of a project's configuration and read it again."""
        path = self.folder / project / "config.json"
        self._save(path, (json.loads(path.read_text()) if path.exists() else {}) | changes)
        return self.config(project)
