"""The command line from page images to text."""

import glob

import numpy as np

from folia import cli
from folia.sources.images import to_png


def read(folder):
    return "".join(open(p, encoding="utf-8").read() for p in sorted(glob.glob(f"{folder}/part-*")))


def test_from_images_to_text(spark, tmp_path, capsys):
    images, store = tmp_path / "images", str(tmp_path / "store")
    images.mkdir()
    for n in range(3):
        gray = np.full((200, 300), 255, dtype=np.uint8)
        for i in range(3):
            gray[20 + 50 * i : 40 + 50 * i, 30:250] = 0
            gray[20 + 50 * i : 40 + 50 * i, 60::20] = 255
        (images / f"{n}.png").write_bytes(to_png(gray))
    assert cli.main(["ingest", str(images), store, "--max-pages", "2"]) == 0
    doc, rest = capsys.readouterr().out.split(maxsplit=1)
    assert rest.strip() == "2 page(s)"
    cli.main(["extract", store, doc[:6], "--pages", "0", "1"])
    cli.main(["ls", store])
    assert doc in capsys.readouterr().out
    cli.main(["text", store, doc, str(tmp_path / "text")])
    text = read(tmp_path / "text")
    assert text.count("== page") == 2 and text.count("-- [1] prose --") == 2 and "نمونہ متن 2" in text
    cli.main(["dump", store, doc, str(tmp_path / "dump")])
    other = str(tmp_path / "other")
    cli.main(["load", other, str(tmp_path / "dump")])
    cli.main(["text", other, doc, str(tmp_path / "again")])
    assert read(tmp_path / "again") == text
    cli.main(["render", store, doc, str(tmp_path / "html")])
    assert read(tmp_path / "html").count('<section class="page">') == 2
    capsys.readouterr()
    for command in (["queries"], ["config"], ["providers"], ["show", store, doc]):
        assert cli.main(command) == 0
    assert "stub" in capsys.readouterr().out
