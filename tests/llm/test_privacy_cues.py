from brindle.llm import privacy as P


def test_every_opening_of_a_name_is_a_cue():
    for text in ("Sincerely, Jane Doe", "Frau Anna Schmidt", "Herr Karl Braun", "Mme Claire Roux", "Sra Lucia Diaz", "Rev John Smith", "Sir John Smith"):
        assert [k for _, _, k in P.find(text)] == ["person_name"], text
