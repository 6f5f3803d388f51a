"""Which elements of a shop's product page hold which raw field.

``TEXT``   first match -> text            ``TEXTS``  all matches -> texts
``ATTRS``  first match -> attributes      ``LINKS``  all matches -> one attribute
``INSIDE`` first match of a box, then the texts of elements in it
``FLAGS``  is there any match             ``ROWS``   specification rows by variant
"""

# Selectors of the first shop's pages.
AMAZON_FIELDS = {
    "TEXT": {
        "title_text": ("#productTitle, #title span, h1#title, span#productTitle, #productTitle_feature_div span", ""),
        "h1_text": ("h1", ""),
        "page_title": ("title", ""),
        "price_text": (
            ".a-price .a-offscreen, #corePriceDisplay_desktop_feature_div .a-offscreen, "
            "#corePrice_feature_div .a-offscreen, #priceblock_ourprice, #priceblock_dealprice, "
            ".apexPriceToPay .a-offscreen, #price_inside_buybox",
            "",
        ),
        "price_whole": (".a-price-whole", ""),
        "price_fraction": (".a-price-fraction", ""),
        "original_text": (
            ".a-text-price .a-offscreen, span.basisPrice .a-offscreen, #listPrice, .priceBlockStrikePriceString",
            "",
        ),
        "rating_text": (
            "i.a-icon-star span.a-icon-alt, #acrPopover .a-size-base, span[data-hook='rating-out-of-text']",
            "",
        ),
        "reviews_text": ("#acrCustomerReviewText, #customer-reviews_feature_div span.a-size-base", ""),
        "desc_text": ("#productDescription p, #productDescription span, #productDescription", " "),
        "info_text": (
            "#important-information, #importantInformation, div[data-feature-name='importantInformation']",
            "\n",
        ),
        "brand_text": ("#bylineInfo, a#bylineInfo", ""),
        "availability_text": ("#availability span", ""),
        "rich_text": ("#aplus_feature_div, .aplus-v2, #dpx-aplus-product-description_feature_div", " "),
        "popularity_text": (
            "#socialProofingAsinFaceout_feature_div, #social-proofing-faceout-title-tk_bought",
            "",
        ),
    },
    "TEXTS": {
        "crumb_texts": "#wayfinding-breadcrumbs_feature_div a, .a-breadcrumb a",
        "bullet_texts": (
            "#feature-bullets ul li span.a-list-item, #featurebullets_feature_div ul li span, #feature-bullets li"
        ),
        "box_texts": "#whatIsInTheBox_feature_div li, #includedComponents_feature_div li, .whats-in-the-box li",
    },
    "ATTRS": {
        "image": (
            "#landingImage, #imgBlkFront, #main-image, #main-image-container img",
            {"image_hires": "data-old-hires", "image_sizes": "data-dynamic-image", "image_src": "src"},
        )
    },
    "LINKS": {"gallery_links": ("#altImages img, #imageBlock img", "src")},
    "INSIDE": {
        "merchant_texts": ("#merchantInfoFeature_feature_div, #merchant-info, #tabular-buybox", "span, a"),
        "return_texts": ("#productSupportAndReturnPolicy_feature_div, #iconfarmv2_feature_div", "span, a"),
    },
    "FLAGS": {"prime_mark": ".s-prime, i.a-icon-prime, span.a-icon-prime, #prime-detail, #bbop-sxs-prime-badge"},
    # variant: (rows, cells, other cells, key cell, value cell)
    "ROWS": {
        "overview": (
            "#productOverview_feature_div tr, div[data-feature-name='productOverview'] tr, "
            "#productOverview_feature_div .po-row",
            "td, th",
            ".po-break-word",
            None,
            None,
        ),
        "details": (
            "#productDetails_db_sections tr, #productDetails_techSpec_section_1 tr, "
            "#productDetails_techSpec_section_2 tr, #technicalSpecifications_section_1 tr, .prodDetTable tr, "
            "#productDetails_feature_div tr, table.a-keyvalue tr",
            "td",
            None,
            "th, td.prodDetSectionEntry, td.a-color-secondary",
            "td.prodDetAttrValue, td.a-size-base, td:not(.prodDetSectionEntry):not(.a-color-secondary)",
        ),
        "bullets": (
            "#detailBullets_feature_div li, #detailBulletsWrapper_feature_div li",
            "span.a-list-item > span",
            None,
            None,
            None,
        ),
        "rich": (
            ".aplus-v2 table tr, #aplus table tr, #dpx-aplus-product-description_feature_div table tr",
            "th, td",
            None,
            None,
            None,
        ),
    },
}

# Selectors of the second shop's pages.
TAKEALOT_FIELDS = {
    "TEXT": {
        "title_text": ("h1, h1.product-title, .product-title", ""),
        "price_text": (
            "span.currency, .buybox-module_price_1wP-n, div[class*=\"price-module\"], span[class*=\"price\"]",
            "",
        ),
        "original_text": (
            ".buybox-module_list-price_2uD8a, span[class*=\"list-price\"], .crossed-out-price, s, del",
            "",
        ),
        "rating_text": (".rating-module_rating_1vVl_, div[class*=\"star-rating\"]", ""),
        "reviews_text": ("a[href*=\"#reviews\"], span[class*=\"review-count\"]", ""),
        "desc_text": ("div[class*=\"description\"], div[class*=\"product-description\"]", " "),
        "info_text": (
            "#important-information, #importantInformation, div[data-feature-name='importantInformation']",
            "\n",
        ),
        "brand_text": ("a[href*=\"/brand/\"], .brand-link", ""),
    },
    "TEXTS": {
        "crumb_texts": (
            ".breadcrumbs-module_breadcrumbs_2bA1p a, .breadcrumbs a, a[href*=\"/all?department=\"]"
        ),
    },
    "ATTRS": {
        "image": (
            "img[src*=\"takealot.com/covers_images/\"], img[src*=\"takealot.com/media/\"], img.gallery-image",
            {"image_src": "src"},
        )
    },
    "LINKS": {},
    "INSIDE": {"bullet_texts": ("div[class*=\"description\"], div[class*=\"product-description\"]", "li")},
    "FLAGS": {},
    "ROWS": {"section": ("div tr, section tr, table tr", "th, td", None, None, None)},
    # containers whose text is read line by line if it holds the mark
    "BLOCKS": ({"div", "section", "table"}, "Product Information", 4000),
}

FIELD_TABLES = {"amazon": AMAZON_FIELDS, "takealot": TAKEALOT_FIELDS}

# Attribute names that stand on a line of their own above their value.
LINE_KEYS = [
    "Brand", "Format", "Ingredients", "Volume", "Barcode", "What's in the box", "Warranty",
    "Gender", "is vegan", "Flavour", "Flavor", "Serving Size", "Servings per Container",
    "Skin Type", "Scent", "Colour", "Color", "Material", "Model", "Model Number",
    "Packed Quantity", "Unit Count", "Assembled Dimensions", "Weight", "Item Weight",
    "Medicine or Substance Schedule", "Zero Rated VAT", "Allergens", "Dietary Needs",
    "Country of Origin", "Age Group", "Pack Count", "Storage Instructions",
]

# Specification keys that hold ingredients, in order.
INGREDIENT_KEYS = [
    "Active Ingredients", "Ingredients", "Special Ingredients", "Key Ingredients",
    "Inactive Ingredients", "Formula", "Composition",
]
