import pytest

from larder.__main__ import main, parse
from larder.plans import refresh


@pytest.fixture
def csv_files(spark, tmp_path):
    paths = {
        "transactions": "BASKET_NUM,HSHD_NUM,PURCHASE_,PRODUCT_NUM,SPEND,UNITS,STORE_R,WEEK_NUM,YEAR\n"
        "1,0010,2018-08-24,5,2.50,1,EAST,34,2018\n2,11,2018-08-25,5,1.25,1,WEST,34,2018\n",
        "products": "PRODUCT_NUM,DEPARTMENT,COMMODITY,BRAND_TY,NATURAL_ORGANIC_FLAG\n5,FOOD,MILK,PRIVATE,N\n",
        "households": "HSHD_NUM,L,AGE_RANGE,MARITAL,INCOME_RANGE,HOMEOWNER,HSHD_COMPOSITION,HH_SIZE,CHILDREN\n"
        "0010,Y,19-24,Single,35K,Renter,1 Adult,1,null\n",
    }
    for name, text in paths.items():
        (tmp_path / f"{name}.csv").write_text(text)
    return [str(tmp_path / f"{name}.csv") for name in ("transactions", "products", "households")]


def test_load_show_detail(csv_files, tmp_path, monkeypatch, capsys):
    monkeypatch.setattr(refresh, "refresh_all", lambda w: w.write({"dept": refresh.SUMMARIES["dept"](w.star)}))
    store = str(tmp_path / "store")
    main(["load", store, *csv_files])
    assert "transactions\t2\t0" in capsys.readouterr().out
    main(["show", store, "dept"])
    assert "FOOD\t3.75" in capsys.readouterr().out
    main(["detail", store, "--household", "0010"])
    out = capsys.readouterr().out
    assert "MILK" in out and "2.50" in out and "1.25" not in out


def test_arguments():
    with pytest.raises(SystemExit):
        parse(["load", "store", "only-two", "files"])
    assert parse(["detail", "s", "--sort", "SPEND", "--descending"]).page == 1
