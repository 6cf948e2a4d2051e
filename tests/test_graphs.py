"""The same small circuit in every layout."""

import pyarrow as pa
import pytest

from sparsewing.sources import arrays, graphs

#: id, type, side; inputs of three dims, one of no dim, one of another sense, one unassigned, one on the other side; cells
NEURONS = [(1, "DA1_lPN", "R"), (2, "DA1_lPN", "R"), (3, "VM2_adPN", "R"), (4, "VP1d_adPN", "R"), (5, "Z_vPN", "R"), (6, "M_l2PNm16", "R"), (7, "DL5_adPN", "L"), (20, "KCg", "R"), (21, "KCab", "R"), (22, "KCg", "L"), (30, "MBON01", "R")]
EDGES = [(1, 20, 2), (2, 20, 3), (2, 20, 1), (3, 20, 1), (3, 21, 4), (4, 21, 9), (5, 21, 9), (6, 21, 9), (7, 21, 9), (7, 22, 5), (30, 20, 9), (1, 30, 9), (20, 20, 9)]
WANT = {("DA1", 20): (6, 2), ("VM2", 20): (1, 1), ("VM2", 21): (4, 1)}


def arrow(at, **columns):
    t = pa.table(columns)
    with pa.OSFile(str(at), "wb") as f, pa.ipc.new_file(f, t.schema) as w:
        w.write_table(t, max_chunksize=3)
    return str(at)


def files(tmp_path, name):
    kind = lambda t, cells, pn: cells if t.startswith("KC") else pn if t.endswith("PN") or "PNm" in t else "other"
    n, e = list(zip(*NEURONS, strict=True)), list(zip(*EDGES, strict=True))
    if name == "typed_csv":
        (tmp_path / "n.csv").write_text("bodyId,type,instance\n" + "".join(f"{i},{t},{t}_{s}\n" for i, t, s in NEURONS if s == "R" or t.endswith("PN")) + "9,,x\n")
        (tmp_path / "e.csv").write_text("bodyId_pre,bodyId_post,weight\n" + "".join(f"{a},{b},{w}\n" for a, b, w in EDGES))
        return str(tmp_path / "n.csv"), str(tmp_path / "e.csv")
    long = {"R": "right", "L": "left"}
    if name == "classed_tsv":
        rows = "".join(f"{i}\t{kind(t, 'Kenyon_Cell', 'ALPN')}\t{t}\t{long[s]}\tx\n" for i, t, s in [*NEURONS, NEURONS[0]])
        (tmp_path / "n.tsv").write_text("root_id\tcell_class\tcell_type\tside\tnote\n" + rows)
        return str(tmp_path / "n.tsv"), arrow(tmp_path / "e.arrow", pre_pt_root_id=e[0], post_pt_root_id=e[1], syn_count=e[2], other=[0.5] * len(EDGES))
    if name == "classed_arrow":
        classes = [kind(t, "kenyon_cell", "antennal_lobe_projection_neuron") for t in n[1]]
        return arrow(tmp_path / "n.arrow", banc_888_id=n[0], cell_class=classes, cell_type=n[1], side=[long[s] for s in n[2]]), arrow(tmp_path / "e.arrow", pre=e[0], post=e[1], count=e[2])
    return arrow(tmp_path / "n.arrow", bodyId=n[0], **{"class": [kind(t, "Kenyon_Cell", "ALPN") for t in n[1]]}, type=n[1], somaSide=n[2]), arrow(tmp_path / "e.arrow", body_pre=e[0], body_post=e[1], weight=e[2])


@pytest.mark.parametrize("name", ["typed_csv", "classed_tsv", "classed_arrow", "bodies_arrow"])
def test_every_layout(spark, tmp_path, name):
    arrays.register(spark)
    n, e = files(tmp_path, name)
    rows = lambda **o: {(r.dim, r.cell): (r.w, r.partners) for r in graphs.circuit(spark, name, n, e, **o).collect()}
    assert rows() == WANT
    assert rows(threshold=4) == {k: v for k, v in WANT.items() if v[0] >= 4}
    assert rows(smell_only=False) == WANT | {("VP1d", 21): (9, 1)}
    if name == "typed_csv":
        with pytest.raises(ValueError, match="no side L"):
            rows(side="L")
    else:
        assert rows(side="L") == {("DL5", 22): (5, 1)}


def test_renamed_dims_and_refusals(spark, tmp_path):
    arrays.register(spark)
    (tmp_path / "n.csv").write_text("bodyId,type,instance\n1,VC3l_adPN,a\n2,VC3m_lvPN,b\n3,VC5_adPN,c\n9,KCg,d\n")
    (tmp_path / "e.csv").write_text("bodyId_pre,bodyId_post,weight\n1,9,1\n2,9,2\n3,9,4\n")
    got = graphs.circuit(spark, "typed_csv", str(tmp_path / "n.csv"), str(tmp_path / "e.csv")).collect()
    assert {r.dim: r.w for r in got} == {"VC3": 1, "VC5": 2, "VM6": 4}
    (tmp_path / "none.csv").write_text("bodyId,type,instance\n9,KCg,d\n")
    with pytest.raises(ValueError, match="no inputs"):
        graphs.circuit(spark, "typed_csv", str(tmp_path / "none.csv"), str(tmp_path / "e.csv"))
    (tmp_path / "odd.csv").write_text("bodyId,type\n9,KCg\n")
    with pytest.raises(ValueError, match="no column instance"):
        graphs.circuit(spark, "typed_csv", str(tmp_path / "odd.csv"), str(tmp_path / "e.csv"))
