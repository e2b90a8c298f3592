"""Hand-marked pages that no classifier was fitted on: a block of main text begins with the mark."""

PAGES = (
    """<html><body><div class="nav-bar"><a href="/">Front</a><a href="/n">News</a><a href="/o">Opinion</a></div><div class="alert-banner">The office is closed on Friday.</div><div class="body-text"><h1>¶Bridge to close for repairs</h1><p>¶The old bridge will be shut to cars from Monday, and buses are to take the long way round through the harbour.</p><p>¶Why now?</p><p>¶Engineers found cracks in two of its nine piers last week, and a third is being watched.</p><p>¶No one was hurt.</p><div class="ad-slot">Tyres fitted while you wait.</div><p>¶Cyclists may use the eastern footway, but must get off and push.</p></div><div class="sidebar-right"><h4>Also read</h4><a href="/x">Council votes on tram</a><p>Readers recommend this week's walk along the canal, which starts at the lock.</p></div><div id="comments"><p>About time too. I drive over it every day and it shakes like a leaf in the wind.</p><p>Agreed</p></div><div class="footer"><p>Printed in town. © 2020</p></div></body></html>""",
    """<body><header><a href="/">Field Guide</a><nav><ul><li><a href="/b">Birds</a></li><li><a href="/t">Trees</a></li></ul></nav></header><main><h1>¶Wren</h1><p>¶A very small bird with a very loud voice.</p><dl><dt>¶Length</dt><dd>¶9 cm</dd><dt>¶Food</dt><dd>¶insects, spiders</dd></dl><h2>¶Nest</h2><p>¶The cock builds several domed nests of moss and leaves, and the hen chooses one and lines it with feathers.</p><ol><li>¶April: building</li><li>¶May: eggs</li></ol></main><aside><p>Help us: report the wrens in your garden and win one of three books.</p></aside><footer><a href="/c">Contact</a></footer></body>""",
    """<body><div><div><a href="/a">Home</a></div><div><a href="/b">Shop</a></div></div><div><div>¶About the workshop</div><div>¶We mend clocks.</div><div>¶Most of those that reach us have stopped because of dust and old oil, and want nothing but a thorough cleaning.</div><div>¶Others need new parts, which we cut ourselves.</div><div>¶Bring yours.</div></div><div><div><a href="/i">Imprint</a></div><div><a href="/p">Privacy</a></div><div>Tel. 555 0101</div></div></body>""",
    """<body><nav><a href="/1">Une</a><a href="/2">Monde</a></nav><article><h1>¶Le marché revient</h1><p>¶Après deux ans de travaux, le marché couvert rouvre samedi ses portes, avec une trentaine de marchands.</p><p>¶« Enfin ! »</p><p>¶Les habitués ont déjà leurs places, et les nouveaux sont invités à se présenter dès sept heures.</p><aside class="related"><a href="/r">La halle en dix dates</a></aside><p>¶Entrée libre.</p></article><section class="comments"><p>Quelle bonne nouvelle pour tout le quartier, il nous manquait beaucoup depuis sa fermeture.</p></section><form><p>Recevez notre lettre chaque vendredi matin.</p></form><footer><p>Tous droits réservés.</p></footer></body>""",
    """<table><tr><td><a href="/">Main page</a> <a href="/faq">FAQ</a></td></tr><tr><td><h2>¶Release 4.2</h2><p>¶This release mends the two faults that made the program stop when a file was empty or its name had a space in it.</p><ul><li>¶empty files</li><li>¶spaces in names</li><li>¶faster start</li></ul><p>¶Thanks!</p><pre>¶tar xf prog-4.2.tar</pre></td></tr><tr><td><a href="/old">Older releases</a></td></tr></table><div class="cookie-consent"><p>This site stores a cookie to remember your language and nothing else at all.</p></div>""",
    """<body><div id="masthead"><p>Weekly of the upper valley, founded 1921</p></div><div id="menu"><a href="/l">Local</a></div><div id="main"><h1>¶Choir seeks tenors</h1><p>¶The choir has forty sopranos.</p><p>¶It has three tenors, of whom one is eighty-four, and would be glad of more before the concert in spring.</p><p>¶Can you sing?</p><p>¶Come on Thursday.</p></div><div class="share-tools"><a href="#">Mail</a><a href="#">Print</a></div><div class="newsletter"><p>All choirs of the valley in one letter.</p></div><div class="bottom"><p>© Valley Weekly</p><a href="/a">Advertise</a></div></body>""",
)
