from lexmill.llm import scan as s


def test_every_header_of_a_long_file_is_known():
    names = [f"租賃契約 甲方{chr(0x4E10 + 7 * k)}{chr(0x5200 + 11 * k)}{chr(0x6200 + 13 * k)}" for k in range(120)]
    text = "\n".join(f"{x}\n本約第{i}款由雙方議定。\n{x}" for i, x in enumerate(names))
    style, heads = s.file_furniture(text)
    assert len(heads) == len({s.line_shape(x) for x in names}) > 100
    assert s.label_lines(names[-1:] + ["本約由雙方議定。"], style, heads) == ["header", "text"]
    assert s.label_lines([names[-1][:-1] + "X"], style, heads) == ["header"]
