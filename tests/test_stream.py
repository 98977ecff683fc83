"""Incremental load: new files only, replays are idempotent, totals add up."""

import shutil

from cartwise.plans import load as L
from cartwise.schema import RAW_HOUSEHOLD_COLUMNS, RAW_PRODUCT_COLUMNS
from cartwise.sources.raw_files import read_raw_csv
from cartwise.streaming.incremental_load import finish, start_incremental_load, stream_report
from test_load_and_dashboard import HOUSEHOLDS, PRODUCTS

HEADER = "BASKET_NUM,HSHD_NUM,PURCHASE_,PRODUCT_NUM,SPEND,UNITS,STORE_R,WEEK_NUM,YEAR\n"


def test_incremental_and_idempotent(spark, tmp_path):
    for name, text in [("households", HOUSEHOLDS), ("products", PRODUCTS)]:
        (tmp_path / name).mkdir()
        (tmp_path / name / "part.csv").write_text(text)
    h = L.clean_households(read_raw_csv(spark, str(tmp_path / "households"), RAW_HOUSEHOLD_COLUMNS))
    p = L.clean_products(read_raw_csv(spark, str(tmp_path / "products"), RAW_PRODUCT_COLUMNS))
    src = tmp_path / "incoming"
    src.mkdir()
    (src / "a.csv").write_text(HEADER + "1,10,17-AUG-18,100,3.49,1,CENTRAL,32,2018\n"
                                        "1,10,17-AUG-18,200,.59,2,CENTRAL,32,2018\n")
    out, ckpt = str(tmp_path / "out"), str(tmp_path / "ckpt")
    finish(start_incremental_load(spark, str(src), h, p, out, ckpt))
    assert tuple(stream_report(spark, out).first()) == (2, 0)
    # A new file: only it is processed on the next run.
    (src / "b.csv").write_text(HEADER + "2,20,18-AUG-18,100,1.00,1,WEST,32,2018\n"
                                        "3,10,19-AUG-18,999,5.00,1,EAST,32,2018\n")
    finish(start_incremental_load(spark, str(src), h, p, out, ckpt))
    assert tuple(stream_report(spark, out).first()) == (3, 1)
    # Nothing new: a rerun adds nothing.
    finish(start_incremental_load(spark, str(src), h, p, out, ckpt))
    assert tuple(stream_report(spark, out).first()) == (3, 1)
    # Losing the commit of the last batch replays it into the same batch folder.
    commits = sorted((tmp_path / "ckpt" / "commits").iterdir(), key=lambda f: f.name)
    last = [c for c in commits if c.name.isdigit()][-1]
    shutil.move(str(last), str(tmp_path / "lost-commit"))
    crc = last.parent / f".{last.name}.crc"
    if crc.exists():
        shutil.move(str(crc), str(tmp_path / "lost-commit.crc"))
    finish(start_incremental_load(spark, str(src), h, p, out, ckpt))
    assert tuple(stream_report(spark, out).first()) == (3, 1)
    assert spark.read.parquet(f"{out}/lines").count() == 3
