"""French stop words; every operator that takes a list accepts another one."""

# Common French function words, the list of the public Snowball stemming project as NLTK ships it.
FRENCH = tuple(
    """
    au aux avec ce ces dans de des du elle en et eux il ils je la le les leur lui ma mais me même
    mes moi mon ne nos notre nous on ou par pas pour qu que qui sa se ses son sur ta te tes toi ton
    tu un une vos votre vous c d j l à m n s t y été étée étées étés étant étante étants étantes
    suis es est sommes êtes sont serai seras sera serons serez seront serais serait serions seriez
    seraient étais était étions étiez étaient fus fut fûmes fûtes furent sois soit soyons soyez
    soient fusse fusses fût fussions fussiez fussent ayant ayante ayantes ayants eu eue eues eus ai
    as avons avez ont aurai auras aura aurons aurez auront aurais aurait aurions auriez auraient
    avais avait avions aviez avaient eut eûmes eûtes eurent aie aies ait ayons ayez aient eusse
    eusses eût eussions eussiez eussent
    """.split()
)
