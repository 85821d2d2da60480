"""Texts for problem 3 that were written down before its rules were; RESIDUE is no content, COPY is what shops really say."""

RESIDUE = [
    # template leftovers of several engines
    "Hi {{contact.firstname}}, welcome back", "Save {% if sale %}20{% endif %} today", "Dear *|FNAME|*, new arrivals", "[[PRODUCT_NAME]] is back in stock", "Free shipping over ${cart.minimum}",
    "<%= t('home.banner') %>", "Shop %COLLECTION_NAME% now", "##HEADLINE## now live", "{brand_name} | {page_title}", "Only %d left in stock", "Hello %(name)s, here is your code", "[%= product.title %]", "~~HERO_COPY~~", "$title$", "@Model.HeroText",
    "content.home.hero.heading", "Save undefined% on bags", "Total: NaN", "null | Official Store", "[object Object] | Bags",
    # fillers
    "Lorem ipsum dolor sit amet", "Ut enim ad minim veniam, quis nostrud", "Add a short description of your brand here", "Heading goes here", "Placeholder headline", "Dummy text for homepage", "TK TK TK", "TODO: hero copy", "Insert image caption here", "Sample text", "Ihr Text hier", "Votre titre ici", "Tu título aquí", "Text to come",
    # error pages
    "404 Page Not Found", "An application error occurred (digest 8831)", "Cette page n'existe pas", "Diese Seite existiert nicht", "Upstream request timeout", "No se encontró la página", "This site can't be reached", "Error: Cannot find module", "Domain not configured", "500 Internal Server Error", "Sorry, this page isn't available", "The requested URL was not found on this server", "Oops! We can't seem to find the page you're looking for",
    "Application error: a client-side exception has occurred", "Uncaught ReferenceError: hero is not defined", "Fatal error: Allowed memory size exhausted", "503 Backend fetch failed", "This account has been suspended", "Pagina niet gevonden", "A página solicitada não existe", "Ein unerwarteter Fehler ist aufgetreten", "Une erreur inattendue s'est produite", "Too many requests, try again later", "Whoops, looks like something went wrong.",
    # scripts, checks, maintenance
    "You need JavaScript to use this site", "JavaScript must be enabled to view this page", "Veuillez activer JavaScript dans votre navigateur", "Por favor, active JavaScript para continuar", "Este sitio requiere cookies y JavaScript", "Your browser is not supported, please upgrade", "Verifying you are human. This may take a few seconds", "Please complete the security check to access this site", "Are you a robot? Please confirm below", "Site under maintenance", "Our store is undergoing scheduled maintenance", "Nous effectuons une maintenance, revenez bientôt",
]

COPY = [
    "Javascript mug for coders", "Access denied? Not with our key rings", "Enter your text here: personalised engraving", "The error of your ways: Monopoly charm bracelets", "Not found in any other shop: the Teal Tote", "404 reasons to love leather", "Page-turner: the reading-chair edit", "Your page, your story: journals & notebooks", "Lost & found: vintage cufflinks", "Null and void? Never. Solid gold rings",
    "Undefined waists, defined style", "Under construction: build your own charm bracelet", "Back soon! Our bestselling clutch restocks Friday", "We'll be back soon with the winter edit", "Coming soon: the pearl collection", "Test your style in two minutes", "Sample sale: up to 60% off", "Tested by parents, loved by kids", "Free returns within 30 days", "Sign up for texts and get 10% off",
    "Text here, talk there: phone slings for everyone", "Add your initials for free", "Add a monogram to any wallet", "Your name goes here - personalised passport covers", "Write your own story with our notebooks", "Tell your story in charms", "Insert coin purse, save space", "The cookie collection: ceramic jars", "Our cookies need no baking: biscuit-shaped earrings", "Scripts & serifs: calligraphy prints",
    "Enable your wanderlust", "Turn on the charm", "Switch on to silver", "Verified reviews from 2,000 customers", "Human made, never robotic", "Robot-print pouches for kids", "Check you out: gingham is back", "Blocked colour, bold shape", "Block-heel boots and matching bags", "Request a repair",
    "Service with a smile", "Connection: jewellery for best friends", "Session essentials: yoga mats & bags", "Timed to perfection: watch rolls", "Bad girls' guide to good bags", "Gateway to summer: beach totes", "The internal pocket edit", "Low maintenance, high style", "Something's gone right: 3 for 2 on scarves", "Oops, we did it again: 20% off everything",
    "Sorry not sorry: the red handbag", "Please wait for no one - next day delivery", "Try again? No need, it fits first time", "Page 3 of 12 | Wallets", "Fehlerfrei verarbeitet: Ledergürtel", "Kein Fehler: 20 % auf alles", "La page blanche : nos carnets", "Página a página: cuadernos de piel", "Nicht gefunden? Frag unser Team", "Sans erreur de goût",
    "{Almost} gone: last sizes", "[Online exclusive] the quilted tote", "<3 made for Valentine's", "50% + 10% off", "100% cotton", "%off event: 20% off", "$5 off your first order", "Save $$$ this weekend", "~ New season ~", "*Selected lines only*",
    "#winterwardrobe is here", "@ our London store this Saturday", "Follow us @brand.official", "Sale! Sale! Sale!", "New, new, new", "Shop www.brand.example today", "A.P.C.-inspired minimalism", "Vol. 2 - The Studio Edit", "Made for you & you & you", "Title deeds & keepsakes box",
]
