"""Pages labelled by hand: ``data-label`` marks what is content (1) and, inside it, what is not (0)."""

LABELLED = (
    """<html><body><header><a href="/">Daily Paper</a><nav class="menu"><ul><li><a href="/1">World</a></li><li><a href="/2">Sport</a></li><li><a href="/3">Weather</a></li></ul></nav></header>
    <div class="cookie-notice"><p>We use cookies to make this site work. Read our policy to learn more.</p><button>Accept</button></div>
    <main><article data-label="1"><h1>Bridge opens after ten years</h1><p>The bridge over the river was opened on Monday. Hundreds of people walked across it in the rain, and the mayor cut a ribbon that had been kept for a decade.</p>
    <h2>Costs</h2><p>It cost twice as much as planned.</p><ul><li>Steel became dearer.</li><li>The ground was softer than the survey said.</li></ul><blockquote>We would build it again.</blockquote>
    <div class="ad" data-label="0">Buy new shoes today, half price.</div><p>Trains follow in spring.</p></article>
    <section id="comments"><h2>Comments</h2><div class="comment"><p>What a waste of money, I said so at the time and I say so now.</p></div><form><label>Name</label><button>Send</button></form></section></main>
    <aside class="sidebar"><h3>Most read</h3><ul><li><a href="/a">Ferry sinks</a></li><li><a href="/b">Harbour to be closed</a></li></ul></aside>
    <footer><p>Copyright Daily Paper. All rights reserved.</p></footer></body></html>""",
    """<html><body><div id="top" class="header"><div class="logo">Garden blog</div><div class="nav"><a href="/">Home</a> <a href="/about">About</a></div></div>
    <div id="wrapper"><div class="post-content" data-label="1"><h1>How to grow beans</h1><p>Beans like warm soil. Sow them in May, two fingers deep, and water them in the evening so that the leaves are dry by noon.</p>
    <p>Harvest early.</p><div><p>Pods that rattle are for next year, so leave some of them on the plant until the frost comes.</p></div><table><tr><td>Dwarf beans</td><td>40 cm</td></tr><tr><td>Runner beans</td><td>3 m</td></tr></table></div>
    <div class="related"><h4>You may also like</h4><a href="/p">How to grow peas</a></div><div class="share social">Share this on your network</div>
    <div class="newsletter"><p>Subscribe to our newsletter and never miss a post about beans or peas.</p><form><input type="text"></form></div></div>
    <div class="sidebar"><div class="widget"><p>I am a gardener from the north and I write about what grows there, every week.</p></div></div>
    <div id="footer">Made with love. Contact. Imprint.</div></body></html>""",
    """<html><body><nav><a href="/">Start</a><a href="/docs">Docs</a></nav><article data-label="1"><header><h1>Reading files</h1></header><p>Open the file, read it line by line, close it.</p><pre>for line in open(path): print(line)</pre>
    <p>A file that is not closed keeps its handle until the program ends, which matters on servers that run for months.</p><section class="comments" data-label="0"><p>Thanks, this helped me a lot with my homework on servers and handles.</p><p>Same here.</p></section></article>
    <footer>Licensed freely &middot; Version 3</footer></body></html>""",
    """<html><body><div class="banner-ad advertisement"><p>Win a trip around the world. Only today, only here, only for our dear readers.</p></div><div class="breadcrumbs"><a href="/">Home</a> &gt; <a href="/n">News</a></div>
    <div class="story" data-label="1"><h1>Council votes</h1><p>The council voted nine to four.</p><p>Members spoke for three hours before the vote, and the gallery was full until midnight.</p><p>The mayor left early.</p><div class="promo" data-label="0">Read all about it in our app</div></div>
    <div class="alert warning">Your browser is out of date. Please update it to see this page as it should be.</div><div class="copyright">2024 Town News</div></body></html>""",
    """<html><body><header role="banner"><h1>Museum of Salt</h1><p>Open daily from ten to six, closed on holidays and in January.</p></header><form class="search"><input name="q"><button>Search</button></form>
    <main data-label="1"><h2>Salt roads</h2><p>Carts carried salt from the sea to the hills.</p><section><h3>Tolls</h3><p>Every bridge had its toll, and every toll its keeper, who lived in the small house beside the road.</p><ol><li>Two pence a cart.</li><li>One penny a mule.</li></ol></section>
    <figure><figcaption>A toll house, about 1800.</figcaption></figure></main><aside><p>Visit our shop for salt from the hills, the sea and the lake.</p></aside><footer><nav><a href="/i">Imprint</a></nav><p>Museum of Salt, Harbour Street</p></footer></body></html>""",
    """<html><body><div id="menu"><ul><li>Recipes</li><li>Tools</li><li>Shop</li></ul></div><div id="content" data-label="1"><div class="entry"><p>Boil the water.</p><p>Add the noodles and stir once, so that they do not stick to the bottom of the pot.</p><p>Wait.</p></div></div>
    <div id="disqus_thread"><div><p>Mine stuck to the pot all the same, what did I do wrong this time?</p></div></div><div class="footer"><p>Write to us about noodles at any time of the day.</p></div></body></html>""",
    """<html><body><ul class="nav"><li><a href="/x">One</a></li><li><a href="/y">Two</a></li></ul><div class="ad">Cheap flights to the islands.</div><article data-label="1"><h1>A short note</h1><p>It rains.</p><p>It has rained for nine days, and the cellar is full of water and of frogs.</p><p>Still.</p></article><div class="modal popup"><p>Leave your mail address and we send you a voucher.</p></div><footer>End</footer></body></html>""",
)
