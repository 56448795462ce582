"""Archives of raw traces, and words about a release."""

from __future__ import annotations

import tarfile
import zipfile
from pathlib import Path


def extract_tarball(path: str, folder: str, prefix: str = "") -> str:
    """Unpacks a tar, members outside the folder refused; returns the first folder in it, by name, that starts with ``prefix``."""
    Path(folder).mkdir(parents=True, exist_ok=True)
    with tarfile.open(path) as tar:
        tar.extractall(folder, filter="data")
    found = sorted(d for d in Path(folder).iterdir() if d.is_dir() and d.name.startswith(prefix))
    if not found:
        raise FileNotFoundError(f"no folder {prefix}* in {path}")
    return str(found[0])


def extract_traces(folder: str, output: str, archives: dict[str, str]) -> tuple[dict[str, int], list[str]]:
    """Unpacks each city's zip of traces (paths within ``folder``) to ``output/city``; files a city, and the cities without one."""
    files: dict[str, int] = {}
    missing = []
    for city, name in archives.items():
        if not Path(folder, name).is_file():
            missing.append(city)
            continue
        with zipfile.ZipFile(Path(folder, name)) as z:
            z.extractall(Path(output, city))
            files[city] = sum(not m.is_dir() for m in z.infolist())
    return files, missing


def release_summary(release: dict) -> str:
    """A loaded release in words: version, build, and the files and megabytes of each city's traces."""
    meta = release["metadata"]
    lines = [f"Release {meta['version']}", f"Built {meta['build_date']} from {meta['git_branch']} ({meta['git_commit']})"]
    for city, files in release["gps"].items():
        size = sum(Path(f).stat().st_size for f in files)
        lines.append(f"{city}: {len(files)} traces, {size / 1e6:.2f} MB")
    return "\n".join([*lines, f"Total: {sum(map(len, release['gps'].values()))} traces"])
