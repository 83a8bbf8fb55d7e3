"""Upload stream: workbooks dropped in a folder land in the dataset store, once."""

import os
import tempfile

from staffline.session import shared_dir
from staffline.sources import store
from staffline.streaming.uploads import ingest_uploads
from tests.xlsx import workbook


def test_upload_stream(spark):
    up = tempfile.mkdtemp(prefix="staffline-up-")
    root = shared_dir(spark, "upload-test", os.urandom(4).hex())
    ckpt = shared_dir(spark, "upload-test-ckpt", os.urandom(4).hex())
    with open(os.path.join(up, "acme.xlsx"), "wb") as f:
        f.write(workbook({"colaboradores": [["matricula", "nome", "data de admissão"], [1, "Ana", "2020-01-02"],
                                            [2, "Rui", "2020-02-03"]],
                          "performance": [["matricula", "avaliação"], [1, "Excepcional"]]}))
    with open(os.path.join(up, "broken.xlsx"), "wb") as f:
        f.write(b"nope")
    q = ingest_uploads(spark, up, root, "owner-1", checkpoint=ckpt)
    q.awaitTermination(120)
    staff = store.read_dataset(spark, root, "staff", "acme", "owner-1")
    assert sorted(r["name"] for r in staff.collect()) == ["Ana", "Rui"]
    assert store.read_dataset(spark, root, "reviews", "acme", "owner-1").count() == 1
    cat = store.list_datasets(spark, root, "owner-1").collect()
    assert [(r["dataset_id"], r["rows"]) for r in cat] == [("acme", 2)]
    assert spark.read.parquet(f"{root}/_errors").count() == 1
    # a second run over the same folder ingests nothing new
    with open(os.path.join(up, "beta.xlsx"), "wb") as f:
        f.write(workbook({"colaboradores": [["matricula", "nome"], [9, "Ivo"]]}))
    os.mkdir(os.path.join(up, "b (1)"))
    with open(os.path.join(up, "b (1)", "acme.xlsx"), "wb") as f:  # the same name in another folder, with a bracket
        f.write(workbook({"colaboradores": [["matricula", "nome"], [3, "Zoé"]]}))
    with open(os.path.join(up, "relatório.xlsx"), "wb") as f:
        f.write(workbook({"colaboradores": [["matricula", "nome"], [4, "Lia"]]}))
    q2 = ingest_uploads(spark, up, root, "owner-1", checkpoint=ckpt)
    q2.awaitTermination(120)
    ids = sorted(r["dataset_id"] for r in store.list_datasets(spark, root, "owner-1").collect())
    assert ids == ["acme", "b (1)/acme", "beta", "relatório"]
    assert [r["name"] for r in store.read_dataset(spark, root, "staff", "b (1)/acme", "owner-1").collect()] == ["Zoé"]
    assert [r["name"] for r in store.read_dataset(spark, root, "staff", "relatório", "owner-1").collect()] == ["Lia"]
    assert store.read_dataset(spark, root, "reviews", "beta", "owner-1").columns[0] == "employee_id"
    assert store.read_dataset(spark, root, "staff", "acme", "owner-1").count() == 2
