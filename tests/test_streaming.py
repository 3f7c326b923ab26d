from dendra.streaming import treebank

BLOCK = "# sent_id = s1\n1\ta\ta\tX\t_\t_\t2\tnsubj\t_\t_\n2\tb\tb\tV\t_\t_\t0\troot\t_\t_\n\n"


def test_counts_of_arriving_files(spark, tmp_path):
    (tmp_path / "in").mkdir()
    for i in range(2):
        (tmp_path / "in" / f"{i}.conllu").write_text(BLOCK * (i + 1))
    counts = treebank.running_counts(treebank.read_files(spark, str(tmp_path / "in")))
    q = counts.writeStream.outputMode("complete").format("memory").queryName("counts").option("checkpointLocation", str(tmp_path / "c")).trigger(availableNow=True).start()
    q.awaitTermination(120)
    assert {r.deprel: r.n for r in spark.table("counts").collect()} == {"nsubj": 3, "root": 3}
